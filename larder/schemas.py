"""Schemas of the domain tables as DDL texts, which every reader takes and which need no running session."""

from __future__ import annotations

USERS = ("id bigint, username string, email string, hashed_password string, created_at timestamp_ntz")
USER_PROFILES = (
    "id bigint, user_id bigint, dietary_restrictions array<string>, allergies array<string>, "
    "favorite_cuisines array<string>, recipe_generation_count int"
)
INVENTORY_ITEMS = (
    "id bigint, user_id bigint, item_name string, quantity double, unit string, expiry_date timestamp_ntz, "
    "category string, created_at timestamp_ntz"
)
RECIPE_HISTORY = (
    "id bigint, user_id bigint, recipe_json variant, raw_response string, user_query string, servings int, "
    "feedback_score int, is_cooked boolean, created_at timestamp_ntz"
)
RECIPE_PREFERENCES = (
    "id bigint, user_id bigint, user_query string, servings int, generation_number int, prompt string, "
    "variant_a variant, variant_b variant, variant_a_raw string, variant_b_raw string, chosen_variant string, "
    "rejected_variant string, chosen_recipe_history_id bigint, created_at timestamp_ntz, chosen_at timestamp_ntz, "
    "skipped boolean, exported_for_training boolean, updated_at timestamp_ntz"
)
INVENTORY = (
    "user_id bigint, item_id bigint, item_name string, quantity double, unit string, category string, "
    "expiry_date string, allergen_flag boolean, unit_cost double, last_updated string, storage_type string, "
    "brand string, nutritional_tags string, daily_usage_rate double, reorder_threshold double, "
    "purchase_date string, source string"
)
PURCHASE_HISTORY = (
    "user_id bigint, transaction_id bigint, item_id bigint, item_name string, quantity_purchased double, "
    "unit string, price_total double, purchase_date string, store_name string, payment_method string, "
    "discount_applied boolean, category string, brand string, location string, receipt_source string, "
    "weekday string, purchase_channel string, consumption_start_date string, expected_depletion_date string"
)
RECEIPTS = ("id bigint, img_url string, ground_truth string, split string, filename string, created_at timestamp_ntz")
RECIPE_ROW = (
    "input struct<user_inventory:array<string>,requested_ingredients:array<string>,user_request:string,"
    "preference:string,cuisine:string>, output variant, scenario string, generated_at string"
)
CHAT_ROW = ("text string, scenario string, user_message string")
SAMPLE = ("text string, metadata struct<dietary_tags:array<string>,recipe_title:string>")
VARIANT_PAIR = (
    "prompt string, variant_a string, variant_b string, "
    "metadata struct<persona:string,user_message:string,inventory:array<string>>"
)
FEEDBACK = ("user_request string, chosen_recipe string, rejected_recipe string, timestamp string")
SET_PREFERENCE = (
    "timestamp string, user_id string, chosen_set string, recipes array<struct<name:string,cuisine:string,"
    "ingredients:array<string>,steps:string>>, request struct<inventory:array<struct<item:string,qty:string,"
    "days_in:int>>,time:string,dietary_preference:string,num_recipes:int>"
)
MODEL_RUN = ("model string, prompt string, output string, latency_sec double, token_count bigint")
REQUEST_LOG = (
    "ts string, level string, logger string, msg string, request_id string, service string, method string, "
    "path string, status int, duration_ms double, user_agent string"
)
VALIDATION_SUMMARY = ("run_ts string, dataset string, suite string, result string")
EVENTS = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
