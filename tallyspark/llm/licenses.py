"""License scans by conditional compression.

Candidate blocks are the stretches of words around license cues.  Each block is compressed alone and
once with every template as a zstandard raw-content dictionary; the reduction is how much the template
shortens the block.  Templates are walked in falling reduction (a title or an SPDX id may shorten a block by nothing and then comes last,
but it comes) and confirmed by exact wording: a template's words are
aligned with the stretch of the block that differs least from them, and the difference, missing and
extra words, is part of the result.  A template is confirmed when it misses none of the words that
tell licenses apart (versions included), at most ``MOST_MISSING`` of all, and has few words in between.
A template is aligned only if a count of the block's words leaves it possible, which loses none.

``TEMPLATES`` are short notices; ``FORMS`` are further wordings of the same and other licenses: texts
(of long ones the head, which stands in front of every copy), standard headers, titles and SPDX ids.

Texts are pre-selected in the scan, by plain parts of the cues and then by their pattern; whole texts reach the tasks, nothing is shuffled.
One row per block and confirmed license, by the confirmed template that shortens the block most.  A
license whose telling words all belong to a larger confirmed notice in the block (the GNU GPL's to the Lesser
GPL's) is not another license.  A block without a confirmed template has one row, of the template that shortens it most; where none
does, its license is null.

Defined cases: a null or empty text has no blocks; blocks are numbered in text order; a cue without a
matching template yields a row that is not confirmed; rows of a block stand by falling reduction, then by
name; long stretches are cut with an overlap, and what two pieces both hold whole has
one row, of the first; rows that repeat a ``doc_id`` are scanned each on its own (ids are returned as long); nulls in other columns change
nothing; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bounded_batches

# The customary short notices of common licenses.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under the CC0 1.0 Universal Public Domain Dedication.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# (license, form, words that tell it from others, wording)
_GNU = {"GPL-2.0": ("", "version 2", "2"), "GPL-3.0": ("", "version 3", "3"), "LGPL-2.1": ("lesser", "version 2.1", "2.1"),
        "LGPL-3.0": ("lesser", "version 3", "3"), "AGPL-3.0": ("affero", "version 3", "3")}
_CC = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial",
       "CC-BY-ND-4.0": "Attribution-NoDerivatives", "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike",
       "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives"}
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. """
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission. """
_BSD_END = """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but
not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."""
FORMS = (
    ("All-rights-reserved", "notice", "all rights reserved", "All rights reserved."),
    ("All-rights-reserved", "notice-de", "rechte vorbehalten", "Alle Rechte vorbehalten."),
    ("All-rights-reserved", "notice-es", "derechos reservados", "Todos los derechos reservados."),
    ("All-rights-reserved", "notice-fr", "tous droits", "Tous droits réservés."),
    ("Apache-2.0", "text", "apache 2.0 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "header", "apache 2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
     License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("Apache-2.0", "title", "apache 2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "title", "apache 2.0", "Apache License 2.0"),
    ("Apache-2.0", "title", "apache 2.0", "Apache 2.0 license"),
    ("Apache-2.0", "title", "apache v2.0", "Apache License v2.0"),
    ("Apache-2.0", "spdx", "apache-2.0", "Apache-2.0"),
    ("Apache-2.0", "spdx", "apache-2.0", "Apache-2.0 OR MIT"),
    ("Apache-2.0", "spdx", "apache-2.0", "MIT OR Apache-2.0"),
    ("Apache-2.0", "spdx", "apache-2.0", "MIT/Apache-2.0"),
    ("BSL-1.0", "text", "boost 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "title", "boost 1.0", "Boost Software License 1.0"),
    ("BSL-1.0", "spdx", "bsl-1.0", "BSL-1.0"),
    ("BSD-2-Clause", "text", "redistribution redistributions retain reproduce", _BSD + _BSD_END),
    ("BSD-2-Clause", "title", "bsd 2-clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "spdx", "bsd-2-clause", "BSD-2-Clause"),
    ("BSD-3-Clause", "text", "redistribution redistributions retain reproduce neither endorse", _BSD + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "title", "bsd 3-clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "spdx", "bsd-3-clause", "BSD-3-Clause"),
    ("CC0-1.0", "text", "cc0 1.0 universal", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "title", "cc0 1.0 universal", "CC0 1.0 Universal"),
    ("CC0-1.0", "title", "cc0", "Creative Commons Zero CC0"),
    ("CC0-1.0", "spdx", "cc0-1.0", "CC0-1.0"),
    ("EPL-2.0", "title", "eclipse 2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "title", "eclipse 2.0", "Eclipse Public License 2.0"),
    ("EPL-2.0", "spdx", "epl-2.0", "EPL-2.0"),
    ("EUPL-1.2", "title", "european union 1.2", "European Union Public Licence v. 1.2"),
    ("EUPL-1.2", "notice", "eupl", "Licensed under the EUPL"),
    ("EUPL-1.2", "spdx", "eupl-1.2", "EUPL-1.2"),
    ("ISC", "text", "copy modify distribute fee hereby granted disclaims", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
     hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
     WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("ISC", "title", "isc", "ISC License"),
    ("ISC", "spdx", "isc", "SPDX-License-Identifier: ISC"),
    ("MIT", "text", "granted free charge deal sublicense substantial portions", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
     sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
     notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
     EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("MIT", "title", "mit license", "MIT License"),
    ("MIT", "title", "mit licensed", "MIT licensed"),
    ("MIT", "title", "mit-licensed", "MIT-licensed"),
    ("MIT", "title", "mit licence", "MIT Licence"),
    ("MIT", "spdx", "mit", "SPDX-License-Identifier: MIT"),
    ("MIT", "spdx", "mit", "License: MIT"),
    ("MIT", "spdx", "mit", "Apache-2.0 OR MIT"),
    ("MIT", "spdx", "mit", "MIT OR Apache-2.0"),
    ("MIT", "spdx", "mit", "MIT/Apache-2.0"),
    ("MPL-2.0", "text", "mozilla 2.0 definitions", "Mozilla Public License Version 2.0 1. Definitions"),
    ("MPL-2.0", "header", "mozilla 2.0 mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
     file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "title", "mozilla 2.0", "Mozilla Public License 2.0"),
    ("MPL-2.0", "title", "mozilla 2.0", "Mozilla Public License, version 2.0"),
    ("MPL-2.0", "spdx", "mpl-2.0", "MPL-2.0"),
    ("Unlicense", "text", "free unencumbered released public domain", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
     or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("Unlicense", "title", "the unlicense", "The Unlicense"),
    *((name, "text", f"gnu {kind} general {digit} verbatim", f"GNU {kind} General Public License {version}, {when} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute "
       "verbatim copies of this license document, but changing it is not allowed.")
      for (name, (kind, version, digit)), when in zip(_GNU.items(), ("June 1991", "29 June 2007", "February 1999", "29 June 2007", "19 November 2007"))),
    *((name, "header", f"gnu {kind} general {digit}", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the "
       f"Free Software Foundation; either {version} of the License, or (at your option) any later version.") for name, (kind, version, digit) in _GNU.items()),
    *((name, "header-only", f"gnu {kind} general {digit}", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License {version} as published by "
       "the Free Software Foundation.") for name, (kind, version, digit) in _GNU.items()),
    *((name, "title", f"gnu {kind} general {digit}", f"GNU {kind} General Public License {version}") for name, (kind, version, digit) in _GNU.items()),
    *((name, "title", f"gnu {kind} general v{digit}", f"GNU {kind} General Public License v{digit}") for name, (kind, _, digit) in _GNU.items()),
    *((name, "title", f"gnu {kind} general v{name.split('-')[1]}", f"GNU {kind} General Public License v{name.split('-')[1]}")
      for name, (kind, _, digit) in _GNU.items() if digit != name.split("-")[1]),
    *((name, "short", f"{short}{sep}{digit}", f"{short.upper()}{sep}{digit}") for name, short, digit in (("GPL-2.0", "gpl", "2"), ("GPL-3.0", "gpl", "3"), ("LGPL-2.1", "lgpl", "2.1"),
                                                                                                        ("LGPL-3.0", "lgpl", "3"), ("AGPL-3.0", "agpl", "3")) for sep in ("v", "-v")),
    *((name, "short", f"gnu {short} v{digit}", f"GNU {short.upper()} v{digit}") for name, short, digit in (("GPL-2.0", "gpl", "2"), ("GPL-3.0", "gpl", "3"), ("LGPL-2.1", "lgpl", "2.1"),
                                                                                                   ("LGPL-3.0", "lgpl", "3"), ("AGPL-3.0", "agpl", "3"))),
    *((name, "spdx", (name + tail).lower(), name + tail) for name in _GNU for tail in ("", "-only", "-or-later")),
    *((name, "title", f"creative {long.lower()} 4.0", f"Creative Commons {long} 4.0 International License") for name, long in _CC.items()),
    *((name, "title", f"creative {long.lower()} 4.0", f"Creative Commons {long} 4.0") for name, long in _CC.items()),
    *((name, "title", f"cc {name[3:-4].lower()} 4.0", f"CC {name[3:-4]} 4.0") for name in _CC),
    *((name, "spdx", name.lower(), name) for name in _CC),
)
CUE = (r"(?i)licen[sc]e|copyright|redistribut|hereby granted|public domain|\bCC0\b|\bCC[ -]BY|all\s+rights\s+reserved|rechte\s+vorbehalten|derechos\s+reservados"
       r"|tous\s+droits|spdx|\bEUPL\b|\bBSL-[0-9]|\u00A9|\(c\)\s*(?:19|20)[0-9][0-9]|\b[AL]?GPL-?v?[0-9]|\bMPL-[0-9]|\bApache-[0-9]|\bBSD-[0-9]|creative\s+commons|gnu\s+(?:\w+\s+)?general\s+public|gnu\s+[al]?gpl\b")
# every text that the pattern finds holds one of these, in lower case
PARTS = ("licen", "copyright", "redistribut", "hereby granted", "public domain", "cc0", "cc by", "cc-by", "rights", "rechte", "derechos", "droits", "spdx", "\u00A9", "(c)", "gpl", "mpl-",
         "apache-", "bsd-", "creative", "gnu", "eupl", "bsl-")
BEFORE, AFTER, LONGEST = 24, 40, 480
MOST_MISSING = 0.25
SCHEMA = ("doc_id long, block long, first_word long, n_words long, license string, reduction double, missing array<string>, extra array<string>, "
          "confirmed boolean")
ARROW = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("license", pa.string()),
                   ("reduction", pa.float64()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string())), ("confirmed", pa.bool_())])


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())


def align(want: list[str], words: list[str], cost: list[int]) -> tuple[list[int], list[int]]:
    """Places in ``want`` and in ``words`` of the cheapest alignment with any stretch of ``words``.

    A word of ``want`` that is left out costs its ``cost``, a word in between costs 1."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.array([number[w] for w in words], np.int64)
    step = np.arange(len(words) + 1)
    rows = [np.zeros(len(words) + 1, np.int64)]
    for w, c in zip(want, cost):
        row = rows[-1] + c
        row[1:] = np.where(at == number.get(w, -1), np.minimum(rows[-1][:-1], row[1:]), row[1:])
        rows.append(np.minimum.accumulate(row - step) + step)
    i, j, held, there = len(want), int(np.argmin(rows[-1])), [], []
    while i:
        if j and words[j - 1] == want[i - 1] and rows[i][j] == rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
            held.append(i)
            there.append(j)
        elif rows[i][j] == rows[i - 1][j] + cost[i - 1]:
            i -= 1
        else:
            j -= 1
    return held[::-1], there[::-1]


class Scanner:
    """Compressors and word lists of the templates, made once per task."""

    def __init__(self, templates: dict[str, str], forms: tuple = FORMS):
        short = {n: _words(t) for n, t in templates.items()}
        used = Counter(w for n in short for w in set(short[n]))
        # what tells a short notice from the others: its rarest words
        rows = [(n, w, {x for x in w if used[x] == min(used[y] for y in w) or any(c.isdigit() for c in x)}, len(w)) for n, w in short.items()]
        rows += [(n, w := _words(t), set(telling.split()), int(MOST_MISSING * len(w))) for n, _, telling, t in forms]
        #: license, words, telling words, most extra words
        self.templates = sorted(rows, key=lambda r: r[:2])
        self.bags = [Counter(w) for _, w, _, _ in self.templates]
        # a telling word is dearer than all the extra words that it may take to reach it
        self.costs = [[len(w) + 2 if x in telling else 2 for x in w] for _, w, telling, _ in self.templates]
        level = dict(level=12, write_content_size=False, write_checksum=False)
        self.plain = zstandard.ZstdCompressor(**level)
        self.primed = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **level)
                       for _, w, _, _ in self.templates]

    def gains(self, words: list[str]) -> list[float]:
        """How much each template shortens the block, as a share of its size compressed alone."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        return [(alone - len(p.compress(data))) / alone for p in self.primed]

    def judge(self, words: list[str]) -> list[tuple]:
        """(license, reduction, missing, extra, confirmed, places of its words) of each license of one block."""
        gains, bag = self.gains(words), Counter(words)
        walk = sorted(range(len(gains)), key=lambda k: (-gains[k], self.templates[k][0], k))
        confirmed = []
        for k in walk:
            _, want, telling, _ = self.templates[k]
            # no alignment misses fewer words than the block lacks
            if sum((self.bags[k] - bag).values()) <= MOST_MISSING * len(want) and all(w in bag for w in telling):
                row, tells = self._compare(words, k, gains[k])
                if row[4]:
                    confirmed.append((row, tells))
        taken: dict[str, tuple] = {}
        for row, tells in confirmed:
            inside = any(len(other[5]) > len(row[5]) and tells <= set(other[5]) for other, _ in confirmed)
            if row[0] not in taken and not inside:
                taken[row[0]] = row
        if taken:
            return list(taken.values())
        if gains[walk[0]] > 0:
            return [self._compare(words, walk[0], gains[walk[0]])[0]]
        return [(None, 0.0, [], [], False, [])]

    def _compare(self, words: list[str], k: int, gain: float) -> tuple:
        """(row, places of the telling words) of a template against a block."""
        name, want, telling, most = self.templates[k]
        held, there = align(want, words, self.costs[k])
        missing = [w for i, w in enumerate(want) if i not in set(held)]
        extra = [words[j] for j in range(there[0], there[-1] + 1) if j not in set(there)] if there else []
        sure = not telling & set(missing) and len(missing) <= MOST_MISSING * len(want) and len(extra) <= most
        return (name, gain, missing, extra, sure, there), {j for j in there if words[j] in telling}


def blocks_of(text: str) -> list[tuple[int, list[str]]]:
    """First word number and words of each stretch around cues; long stretches are cut with an overlap."""
    cue = re.compile(CUE)
    if not cue.search(text):
        return []
    spots = list(re.finditer(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower()))
    starts = [m.start() for m in spots]
    spans: list[list[int]] = []
    for m in cue.finditer(text.lower()):
        at = max(bisect.bisect_right(starts, m.start()) - 1, 0)
        lo, hi = max(at - BEFORE, 0), min(at + AFTER, len(spots))
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    out = []
    for lo, hi in spans:
        while True:
            out.append((lo, [spots[i].group() for i in range(lo, min(hi, lo + LONGEST))]))
            if hi - lo <= LONGEST:
                break
            lo += LONGEST // 2
    return out


def license_blocks(docs: DataFrame, templates: dict[str, str] = TEMPLATES, forms: tuple = FORMS) -> DataFrame:
    """One row per candidate block of ``docs`` ``(doc_id, text)`` and license confirmed in it."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, forms)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen = set()
                for number, (first, words) in enumerate(blocks_of(text.as_py())):
                    for name, gain, missing, extra, sure, there in scanner.judge(words):
                        places = (name, *(first + j for j in there))
                        if sure and places in seen:
                            continue
                        seen.add(places)
                        rows.append({"doc_id": doc, "block": number, "first_word": first, "n_words": len(words), "license": name, "reduction": gain,
                                     "missing": missing, "extra": extra, "confirmed": sure})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    low = F.lower("text")
    some = F.lit(False)
    for part in PARTS:
        some = some | low.contains(part)
    candidates = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(some & F.col("text").rlike(CUE))
    return candidates.mapInArrow(work, SCHEMA)
