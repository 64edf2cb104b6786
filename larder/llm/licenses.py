"""License notices found by conditional compression.

Candidate blocks are the lines and paragraphs with a license's cue words. Around
each cue every wording has a window of its own length, which is compressed with
zstandard, once alone and once with the wording as raw dictionary. Wordings that
save a share of what they save on themselves are ranked by the bytes saved and
confirmed by their exact differences in words; of those that lie over each other
the one that saves most is the notice.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from larder.llm.common import chunks_of, table_of

#: Share of a wording's words that may differ.
MOST_DIFFERENCES = 0.2
#: Share of the bytes that a wording saves on itself that a window must save with it.
LEAST_SAVED = 0.2
SLICE = 4 << 20
#: The level that finds matches of three bytes: notices are short.
LEVEL = 19

# License names and wordings of their notices.
WORDINGS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Released under the BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
CUES = re.compile(r"licen[cs]e|permission\s+(?:is\s+hereby|to\s+use)|redistribut|public\s+domain", re.I)

PART = re.compile(r"\S+")


def bare(word: str) -> str:
    return word.strip(".,;:()\"'").lower()


def packed(block: list[str]) -> bytes:
    """Words as they are compressed: line breaks and punctuation between them make no difference."""
    return " ".join(block).encode("utf-8", "replace")


class Wording:
    """A wording, ready to be compared with blocks."""

    def __init__(self, name: str, text: str):
        self.name, self.text = name, text
        self.words = [bare(w) for w in text.split()]
        self.counts = Counter(self.words)
        self.radius = len(self.words) + int(MOST_DIFFERENCES * len(self.words)) + 1
        # Versions and short names tell licenses apart; a block must have them all.
        self.needed = {bare(w) for w in text.split() if re.search(r"\d", w) or bare(w).upper() == w.strip(".,;:()\"'") and len(bare(w)) > 1}
        own = packed(self.words)
        raw = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw)
        self.floor = LEAST_SAVED * self.saved(own, len(zstandard.ZstdCompressor(level=LEVEL).compress(own)))

    def saved(self, block: bytes, plain: int) -> int:
        """The bytes of the block's compressed size that knowing the wording saves."""
        return plain - len(self.compressor.compress(block))

    def possible(self, block: list[str]) -> bool:
        """Whether a block has the needed words and so many of the wording's that no more than MOST_DIFFERENCES can differ."""
        if not self.needed.issubset(block):
            return False
        return (self.counts - Counter(block)).total() <= MOST_DIFFERENCES * len(self.words)

    def differences(self, block: list[str]) -> tuple[int, int, int] | None:
        """(first word, end, words that differ) of the wording in a block; None if a needed word is missing."""
        matcher = SequenceMatcher(None, block, self.words, autojunk=False)
        same = [m for m in matcher.get_matching_blocks() if m.size]
        if not same:
            return None
        first, end = same[0].a, same[-1].a + same[-1].size
        if not self.needed <= set(block[first:end]):
            return None
        matched = sum(m.size for m in same)
        return first, end, max(end - first, len(self.words)) - matched + max(0, min(end - first, len(self.words)) - matched)


def blocks_of(text: str) -> list[tuple[int, int]]:
    """Places of the lines with a cue and of the paragraphs around them."""
    out = []
    for m in CUES.finditer(text):
        line = (text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start()))
        paragraph = (text.rfind("\n\n", 0, m.start()) + 1, text.find("\n\n", m.start()))
        out += [(s, e if e >= 0 else len(text)) for s, e in (line, paragraph)]
    return sorted(set(out))


def ranked(words: list[str], cue: int, wordings: list[Wording], alone: zstandard.ZstdCompressor) -> list[tuple[int, float, int, list[str], Wording]]:
    """(bytes saved, their share, window's first word, window, wording) around a cue, what saves most first; wordings below their floor are left out."""
    out, windows = [], {}
    for w in wordings:
        if w.radius not in windows:
            low = max(0, cue - w.radius)
            window = words[low:cue + w.radius + 1]
            block = packed(window)
            windows[w.radius] = low, window, block, len(alone.compress(block))
        low, window, block, plain = windows[w.radius]
        saved = w.saved(block, plain)
        if saved >= w.floor:
            out.append((saved, saved / plain, low, window, w))
    return sorted(out, key=lambda r: -r[0])


def notices(text: str, wordings: list[Wording]) -> list[tuple[str, int, int, float, int]]:
    """(license, start, end, saved, differences) of a text, places in code points; one for each place, the one that saves most."""
    found = set()
    alone = zstandard.ZstdCompressor(level=LEVEL)
    for start, end in blocks_of(text):
        words = list(PART.finditer(text, start, end))
        starts, all_bare = [w.start() for w in words], [bare(w.group()) for w in words]
        for cue in sorted({bisect_right(starts, m.start()) - 1 for m in CUES.finditer(text, start, end)}):
            for saved, share, low, window, w in ranked(all_bare, cue, wordings, alone):
                d = w.differences(window) if w.possible(window) else None
                if d and d[2] <= MOST_DIFFERENCES * len(w.words):
                    found.add((w.name, words[low + d[0]].start(), words[low + d[1] - 1].end(), share, d[2], len(w.words), saved))
    best: list[tuple] = []
    for f in sorted(found, key=lambda f: (-f[6], f[4], -f[5], -f[3], f[1], f[0])):
        if all(f[2] <= b[1] or f[1] >= b[2] for b in best):
            best.append(f)
    return sorted((f[:5] for f in best), key=lambda f: f[1])


def licensed(docs: DataFrame, wordings: tuple = WORDINGS) -> DataFrame:
    """One row per notice found: doc_id, license, start, stop (code points), saved, differences, notice.

    Null and empty texts and texts without a notice give no row. Repeated rows
    give repeated results; a null doc_id stays null.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Wording(*w) for w in wordings]
        for batch in batches:
            for part in chunks_of(batch, "text", SLICE):
                rows = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    if text and CUES.search(text):
                        rows += [(i, *n, text[n[1]:n[2]]) for n in notices(text, ready)]
                if rows:
                    at, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(at)), *[pa.array(c) for c in rest]], ["doc_id", "license", "start", "stop", "saved", "differences", "notice"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table_of(docs, "doc_id", "text").mapInArrow(of, f"doc_id {kind}, license string, start long, stop long, saved double, differences long, notice string")
