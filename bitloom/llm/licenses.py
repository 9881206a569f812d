"""License scans by conditional compression.

A block begins at a line that speaks of a license. For each template, the block's first words, about as many as the
template has, are compressed alone and with the template as a raw Zstandard dictionary; the templates are ranked by the
share of the size that the dictionary saves. The first of them whose exact wording the block has, but for few
differences and none in a telling word (a number, "non", "lesser", ...), is the block's license.

Defined results: a null or empty text has no blocks; a block of no confirmed license is reported with a null license
where asked for (``unknown``), else not; blocks do not overlap; of templates that save alike the longer, then the first
by name is tried first. Texts and lines of any length are scanned alike, whole; rows that repeat an id are scanned each; an
empty table gives no rows. Further columns don't pass; an id column named like a result gets an underscore.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bitloom.llm.common import free_name, ship, table

#: The wording of well-known notices and licenses, by SPDX identifier.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Words in which no difference is allowed.
TELLING = frozenset("not non no without nc nd sa by lesser affero mit apache gnu mozilla bsd isc cc cc0 neither noncommercial sharealike noderivatives".split())
TOLERANCE, SLACK, LEVEL, LEAST_GAIN = 0.1, 1.15, 19, 0.2
_CUE = re.compile(r"licen[cs]e|copyright|redistribution and use|permission (?:is hereby|to use)|free software|public domain|creative commons|spdx", re.I)
_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
_SENTENCE = re.compile(r"[.!?|]\s+")


@lru_cache(maxsize=1)
def templates() -> list[tuple]:
    """(identifier, words, compressor with the template as its dictionary) of each."""
    made = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            words = [w.lower() for w in _WORD.findall(text)]
            raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.append((name, words, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False)))
    return made


def differences(words: list[str], template: list[str]) -> tuple[list[str], int]:
    """The wording's differences from a template, as -word and +word, and how many of the words the template covers.

    The block may go on after the template: what follows its last equal word is no difference."""
    out, used = [], 0
    ops = difflib.SequenceMatcher(None, template, words, autojunk=False).get_opcodes()
    ends = [o[4] for o in ops if o[0] == "equal"]
    used = ends[-1] if ends else 0
    for op, a, b, c, d in ops:
        if op != "equal":
            out += [f"-{w}" for w in template[a:b]] + [f"+{w}" for w in words[c : min(d, used)]]
    return out, used


def scan_block(words: list[str]) -> tuple[str | None, float, list[str], int]:
    """License, saved share, differences and length in words of the block that starts with these words."""
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    ranked, sizes = [], {}
    for name, template, pressed in templates():
        n = min(len(words), int(len(template) * SLACK) + 1)
        block = " ".join(words[:n]).encode()
        size = sizes.get(n) or sizes.setdefault(n, len(plain.compress(block)))
        ranked.append(((size - len(pressed.compress(block))) / size, len(template), name, template, n))
    ranked.sort(key=lambda r: (-r[0], -r[1], r[2]))
    for gain, _, name, template, n in ranked:
        if gain < LEAST_GAIN:
            break
        found, used = differences(words[:n], template)
        if len(found) <= max(1, TOLERANCE * len(template)) and not any(w[1:] in TELLING or any("0" <= c <= "9" for c in w) for w in found):
            return name, gain, found, used
    return None, ranked[0][0], [], 0


def scan(text: str | None, unknown: bool = False) -> list[tuple]:
    """(start, end, license, gain, differences) of each block, in code points."""
    out, done = [], 0
    if not text or not _CUE.search(text):
        return out
    most = int(SLACK * max(len(t[1]) for t in templates())) + 2
    starts, sentences = ([f(m) for m in r.finditer(text)] for r, f in ((_WORD, re.Match.start), (_SENTENCE, re.Match.end)))
    known: dict[int, tuple] = {}
    for cue in _CUE.finditer(text):
        if cue.start() < done:
            continue
        line = text.rfind("\n", 0, cue.start()) + 1
        # a block may begin at its line, or at a sentence within it from which it reaches the cue
        before = bisect_left(starts, cue.start()) - most - 1
        near = max(line, starts[before] + 1 if before >= 0 else 0)
        begins = sorted({line, *sentences[bisect_left(sentences, near) : bisect_right(sentences, cue.start())]})
        best = None
        for begin in begins:
            begin = max(begin, done)
            if begin not in known:
                places = list(islice(_WORD.finditer(text, begin), most))
                name, gain, found, used = scan_block([m[0].lower() for m in places])
                known[begin] = (places[0].start(), places[used - 1].end(), name, gain, found) if name else None
            if known[begin] and (best is None or len(known[begin][4]) < len(best[4])):
                best = known[begin]
        if best:
            out.append(best)
            done = best[1]
        elif unknown:
            end = text.find("\n", cue.start())
            out.append((line, len(text) if end < 0 else end, None, None, []))
            done = out[-1][1]
        else:
            done = cue.end()
    return out


def _scanner(unknown: bool, names: list[str]):
    def run(batches):
        for batch in batches:
            rows = [(id, *x[:4], len(x[4]), " ".join(x[4])) for id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in scan(text, unknown)]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names)

    return run


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", unknown: bool = False) -> DataFrame:
    """(id, start, end, license, gain, n_differences, differences): one row for each block."""
    ship(docs.sparkSession)
    names = ["start", "end", "license", "gain", "n_differences", "differences"]
    names = [free_name(id, names), *names]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.DoubleType(), T.LongType(), T.StringType()]
    schema = T.StructType([T.StructField(names[0], docs.schema[id].dataType), *(T.StructField(n, k) for n, k in zip(names[1:], kinds))])
    return docs.select(id, text).mapInArrow(_scanner(unknown, names), schema)


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
