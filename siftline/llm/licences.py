"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

Paragraphs are lines, and notices that go on over several consecutive lines or share a line with another. A multinomial logistic
regression on the sparse word n-grams (n = 1, 2, 3) of a paragraph names one of the licence families or none of them ("unknown"); it is
trained on templates (notices, and the names of licences in the usual phrases), on variants of them made by rule, and on ordinary
text. Its probabilities are calibrated by a temperature, and the probability that a family needs against the unknown class is set on
held-back negatives. A family then counts only if a template of that family confirms it: most of the template's word bigrams are in
the paragraph.

After the lines, each template is looked for in every run of consecutive lines with words, whatever their ends; the
same classifier judges the words that it spans alone, so wrapped notices and several families in a line are found.

Every paragraph is judged. The comparison comes first where it is cheap: a line in which no template has enough of its bigrams cannot be
confirmed, and is passed over without computing its probabilities.

Defined cases: null, empty and blank texts have no paragraphs and the family null. Rows that repeat get equal
results, and a null ``doc_id`` is kept. An empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import fields
from .memory import trim
from .textnum import Words, batches, mix64

# Notices by which well-known licences are granted, by family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without permission.", "Copyright. All rights reserved.", "All rights reserved."],
}
# Names under which licences are granted in a phrase, by family.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache 2.0", "Apache-2.0", "Apache Software License"],
    "MIT": ["MIT License", "MIT/X11 license", "MIT", "Expat License"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPL", "GPL license", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL version 2", "GPL version 3"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1", "LGPL-3.0"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD license", "2-clause BSD license", "New BSD License", "Simplified BSD License", "BSD-2-Clause", "BSD-3-Clause", "BSD"],
    "MPL-2.0": ["Mozilla Public License", "Mozilla Public License, Version 2.0", "MPL 2.0", "MPL-2.0", "MPL"],
    "ISC": ["ISC License", "ISC"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0"],
    "EPL": ["Eclipse Public License", "Eclipse Public License, Version 2.0", "EPL 2.0", "EPL-2.0"],
    "EUPL": ["European Union Public Licence", "European Union Public License", "EUPL", "EUPL, Version 1.2", "EUPL-1.2"],
    "Zlib": ["zlib License", "zlib/libpng license"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC-BY-4.0", "CC BY"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC"],
    "CC0": ["CC0 1.0 Universal", "CC0 1.0", "CC0", "Unlicense"],
}
# More notices of the families that only have names above, and headings of licence texts.
NOTICES = {
    "AGPL": ["You should have received a copy of the GNU Affero General Public License along with this program."],
    "LGPL": ["You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "GPL": ["You should have received a copy of the GNU General Public License along with this program.", "You can redistribute it under the terms of the GPL"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"],
    "EUPL": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "BSD": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "MIT": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
}
# Phrases that grant, before a name; and what comes before or after a name of one word where it names a licence.
GRANTS = ["Licensed under", "Released under", "Distributed under", "Published under", "Available under", "Provided under", "Covered by", "Governed by", "Subject to"]
AROUND = ["under {}", "under the {}", "License: {}", "SPDX-License-Identifier: {}", "{} license", "{} licensed", "{} only", "{} or later"]


def _templates() -> dict[str, list[str]]:
    """What confirms, by family: notices, names of several words, and names of one word with a word beside them."""
    out = {family: list(notices) for family, notices in TEMPLATES.items()}
    for family, notices in NOTICES.items():
        out.setdefault(family, []).extend(notices)
    for family, names in NAMES.items():
        own = out.setdefault(family, [])
        for name in names:
            own += [name] if " " in name else [around.format(name) for around in AROUND]
    return {family: list(dict.fromkeys(own)) for family, own in out.items()}


def _granted(family: str) -> list[str]:
    """Names of a family in the phrases that grant, for fitting."""
    return [f"{grant} {article}{name}" for name in NAMES.get(family, []) for grant in GRANTS for article in ("", "the ")]


# Sentences with words of licences that grant none.
NEGATIVES = [
    "You need a driving license to rent a car.", "The license plate was found near the public library.", "He wrote the general terms of the work under the table.",
    "The project was released in May and this version is free.", "A member of the public asked for permission to use the software.", "All rights and duties of members are listed below.",
    "The Apache helicopter was redistributed in source and binary stars.", "MIT is a university.", "Version 2.0 of the program adds a new library.", "The creative commons room is open to the public.",
    "The album was released under the name of the band.", "Licensed under the authority of the council, the shop sells wine.", "The drug is distributed under the brand name of its maker.", "The book was published under a pseudonym.",
    "Rooms are available under the terms of the lease.", "The costs are covered by the city.", "The region is governed by a council.", "Prices are subject to change.", "Help is provided under the general public health plan.", "A fishing license is needed at the lake.",
    "The Mozilla browser was released under much public interest.", "The eclipse was public and version 2.0 of the show.", "He boosts the software with general public support.", "Expat workers need a license to trade.",
    "This work is under review by the general assembly.", "The terms of the agreement were published in 2020.", "Copyright law is a difficult subject.", "Free software was the topic of the conference.",
]
UNKNOWN = "unknown"
ALL_TEMPLATES = _templates()
CLASSES = [UNKNOWN, *ALL_TEMPLATES]
CONFIRM = 0.6
#: Ordinary text for fitting: documents, code points of each at most, and paragraphs of them, all chosen by hash.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_PARAGRAPHS = 500, 20_000, 4000
SEED = 17
_CUT = np.arange(256, dtype=np.uint8)
_CUT[list(b"\t\r\x0b\x0c.,;:!?'\"()[]*#&%$/<>")] = 32
_LINK = np.random.default_rng(99).integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ngrams(words: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of the n-grams that do not cross lines."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = total + words[k : len(words) - n + 1 + k] * _LINK[k]
    same = line[n - 1 :] == line[: len(line) - n + 1]
    return mix64(total[same]), line[: len(line) - n + 1][same]


def _paragraph_words(raw: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words without punctuation, and the line of each."""
    words = Words(_CUT[raw])
    return words, np.searchsorted(np.flatnonzero(raw == 10), words.start)


def _grams_of(text: str) -> list[np.ndarray]:
    words, line = _paragraph_words(np.frombuffer(text.encode() + b"\n", np.uint8))
    return [ngrams(words.hash, np.zeros_like(line), n)[0] for n in (1, 2, 3)]


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray  # vocabulary x classes
    bias: np.ndarray
    temperature: float
    threshold: float
    templates: list[tuple[int, np.ndarray]]  # class, sorted distinct bigrams

    def __post_init__(self):
        pairs = sorted((int(g), k) for k, (_, t) in enumerate(self.templates) for g in t.tolist())
        self.every, first = np.unique(np.array([g for g, _ in pairs], np.uint64), return_index=True)
        self.owners, self.starts = np.array([k for _, k in pairs], np.int64), np.append(first, len(pairs))
        self.need = np.array([int(np.ceil(CONFIRM * len(t) - 1e-9)) for _, t in self.templates])

    def confirmable(self, words: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Lines with enough bigrams of some template."""
        grams, where = ngrams(words, line, 2)
        at = np.minimum(np.searchsorted(self.every, grams), len(self.every) - 1)
        hit = self.every[at] == grams
        pair = np.unique(where[hit] * len(self.every) + at[hit])
        own, gram = pair // len(self.every), pair % len(self.every)
        size = np.diff(self.starts)[gram]
        owner = self.owners[np.arange(size.sum()) + np.repeat(self.starts[gram] - np.concatenate([[0], np.cumsum(size)])[:-1], size)]
        key, n = np.unique(np.repeat(own, size) * len(self.templates) + owner, return_counts=True)
        return np.unique(key[n >= self.need[key % len(self.templates)]] // len(self.templates))

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return at, self.vocabulary[at] == hashes

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def spans(self, h: np.ndarray, line: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int, float, float]]:
        """(first word, last word, doc, class, probability, share) of notices anywhere in runs of consecutive lines, also across their ends."""
        if len(h) < 2:
            return []
        run = np.cumsum(np.concatenate([[0], (np.diff(line) > 1) | (np.diff(doc) != 0)]))
        grams = mix64(np.uint64(2) + h[:-1] * _LINK[0] + h[1:] * _LINK[1])
        at = np.minimum(np.searchsorted(self.every, grams), len(self.every) - 1)
        hits = np.flatnonzero((self.every[at] == grams) & (run[1:] == run[:-1]))
        # Of each template the places of its bigrams: only templates that have some are looked at.
        size = np.diff(self.starts)[at[hits]]
        spots = np.repeat(hits, size)
        which = self.owners[np.arange(size.sum()) + np.repeat(self.starts[at[hits]] - np.concatenate([[0], np.cumsum(size)])[:-1], size)]
        order = np.argsort(which, kind="stable")
        spots, which = spots[order], which[order]
        edges = np.append(np.flatnonzero(np.diff(which, prepend=-1)), len(which))
        out = []
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            c, t = self.templates[which[begin]]
            need = int(np.ceil(CONFIRM * len(t) - 1e-9))
            own = spots[begin:end]
            close = np.zeros(0, np.int64)
            if len(own) >= need:  # places from which enough hits follow within twice the notice's length
                close = np.flatnonzero((own[need - 1 :] - own[: len(own) - need + 1] <= 2 * len(t)) & (run[own[need - 1 :]] == run[own[: len(own) - need + 1]]))
            after = -1
            for k in close:
                if own[k] <= after:
                    continue
                inside = own[k : int(np.searchsorted(own, own[k] + len(t) + need, side="right"))]
                inside = inside[run[inside] == run[own[k]]]
                share = len(np.unique(grams[inside])) / len(t)
                if share < CONFIRM:
                    continue
                last = int(inside[-1]) + 1
                words = h[own[k] : last + 1]
                found = np.unique(np.concatenate([ngrams(words, np.zeros(len(words), np.int64), n)[0] for n in (1, 2, 3)]))
                place, ok = self.found(found)
                p = self.probabilities(self.weights[place[ok]].sum(axis=0)[None])[0]
                if p[1:].argmax() + 1 == c and p[c] >= self.threshold:
                    out.append((int(own[k]), last, int(doc[own[k]]), c, float(p[c]), share))
                    after = last
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, float, float]]]:
        """Per text (family, probability, share of the confirming template), one for each licence paragraph."""
        out: list[list[tuple[str, float, float]]] = [[] for _ in texts]
        for first, raw, offsets in batches(texts):
            words, line = _paragraph_words(raw)
            doc_of = np.searchsorted(offsets, words.start, side="right") - 1
            keep = np.isin(line, self.confirmable(words.hash, line)) if len(line) else np.zeros(0, bool)
            whole: set[tuple[int, int]] = set()  # line and class of the notices that one line holds
            spans = self.spans(words.hash, line, doc_of)
            if not keep.any() and not spans:
                continue
            h, ln = words.hash[keep], line[keep]
            lines, ln = np.unique(ln, return_inverse=True)
            logits = np.zeros((len(lines), len(CLASSES)))
            pairs = None
            for n in (1, 2, 3):
                grams, where = ngrams(h, ln, n)
                if n == 2:
                    pairs = grams, where
                at, ok = self.found(grams)
                both = np.unique(where[ok] * len(self.vocabulary) + at[ok])  # presence, not counts
                np.add.at(logits, both // len(self.vocabulary), self.weights[both % len(self.vocabulary)])
            p = self.probabilities(logits)
            best = p[:, 1:].argmax(axis=1) + 1
            newline = np.concatenate([[-1], np.flatnonzero(raw == 10)])
            for k in np.flatnonzero(p[np.arange(len(p)), best] >= self.threshold):
                own = np.unique(pairs[0][pairs[1] == k])
                share = max(np.isin(t, own).mean() for c, t in self.templates if c == best[k])
                if share >= CONFIRM:
                    doc = int(np.searchsorted(offsets, newline[lines[k]] + 1, side="right")) - 1
                    out[first + doc].append((CLASSES[best[k]], float(p[k, best[k]]), float(share)))
                    whole.add((int(lines[k]), int(best[k])))
            taken: list[tuple[int, int, int]] = []
            for a, b, doc, c, probability, share in sorted(spans, key=lambda x: (-x[5], x[0])):
                if any((n, c) in whole for n in range(int(line[a]), int(line[b]) + 1)) or any(k == c and a <= y and x <= b for x, y, k in taken):
                    continue
                taken.append((a, b, c))
                out[first + doc].append((CLASSES[c], probability, share))
        return out


def _variants(text: str, rng: np.random.Generator) -> list[str]:
    """The notice with years, versions and surroundings as they occur."""
    lead = ["", "Copyright 2021 Example Authors. ", "Note: ", "# ", "This repository: ", "Copyright (c) 2019 A. Author. "]
    tail = ["", " See the LICENSE file for details.", " Please read the full text.", " Contributions are welcome."]
    out = [a + text + b for a in lead for b in tail]
    words = text.split()
    for _ in range(6):
        if len(words) > 8:
            cut = int(rng.integers(6, len(words)))
            out.append(" ".join(words[:cut]))
    return out


def train(ordinary: list[str], seed: int = SEED) -> Model:
    """Fit on the templates and on ``ordinary`` texts, of which ``SAMPLE_PARAGRAPHS`` paragraphs at most, chosen by hash."""
    rng = np.random.default_rng(seed)
    notices = [np.unique(_grams_of(t)[1]) for ts in ALL_TEMPLATES.values() for t in ts]
    plain = {line for text in ordinary for line in text.split("\n") if line.strip() and not re.search(r"(?i)licen[sc]e|rights reserved|\bCC\b", line)}
    plain = sorted(plain, key=lambda line: hashlib.blake2b(line.encode("utf-8", "surrogatepass"), salt=seed.to_bytes(8, "big")).digest())[:SAMPLE_PARAGRAPHS]
    owners: dict[int, list[int]] = {}
    for k, t in enumerate(notices):
        for g in t.tolist():
            owners.setdefault(g, []).append(k)

    def confirmed(line: str) -> bool:
        hits = Counter(k for g in set(_grams_of(line)[1].tolist()) for k in owners.get(g, ()))
        return any(n >= CONFIRM * len(notices[k]) for k, n in hits.items())

    notice = [confirmed(line) for line in plain]
    plain = [line for line, n in zip(plain, notice, strict=True) if not n]  # what is a notice is no ordinary text
    full = {name: {*TEMPLATES.get(name, []), *NOTICES.get(name, [])} for name in CLASSES[1:]}
    rows = [(v, k) for k, name in enumerate(CLASSES[1:], 1) for t in ALL_TEMPLATES[name] for v in (_variants(t, rng) if t in full[name] else [t])]
    rows += [(t, k) for k, name in enumerate(CLASSES[1:], 1) for t in _granted(name)]
    rows += [(v, 0) for t in NEGATIVES for v in _variants(t, rng)] + [(t, 0) for t in plain]
    grams = [np.unique(np.concatenate(_grams_of(t))) for t, _ in rows]
    y = np.array([k for _, k in rows])
    vocabulary = np.unique(np.concatenate([g for g, k in zip(grams, y, strict=True) if k] + [np.concatenate(_grams_of(t)) for t in NEGATIVES]))
    lists = [np.searchsorted(vocabulary, g[np.isin(g, vocabulary)]) for g in grams]
    weights, bias = np.zeros((len(vocabulary), len(CLASSES))), np.zeros(len(CLASSES))
    power, b_power = np.full_like(weights, 1e-3), np.full_like(bias, 1e-3)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    model = Model(vocabulary, weights, bias, 1.0, 0.5, [(k, np.unique(_grams_of(t)[1])) for k, name in enumerate(CLASSES[1:], 1) for t in ALL_TEMPLATES[name]])
    raw = lambda who: np.stack([weights[lists[k]].sum(axis=0) for k in who])
    for _ in range(8):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            error = model.probabilities(raw(part))
            error[np.arange(len(part)), y[part]] -= 1
            for k, e in zip(part, error, strict=True):
                g = e / len(part) + 1e-4 * weights[lists[k]]
                power[lists[k]] += g * g
                weights[lists[k]] -= 0.2 * g / np.sqrt(power[lists[k]])
            b = error.mean(axis=0)
            b_power += b * b
            bias -= 0.2 * b / np.sqrt(b_power)
    logits, target = raw(held), y[held]

    def loss(t: float) -> float:
        model.temperature = t
        return float(-np.log(np.maximum(model.probabilities(logits)[np.arange(len(held)), target], 1e-12)).mean())

    model.temperature = float(min(np.geomspace(0.5, 8, 41), key=loss))
    false = model.probabilities(logits[target == 0])[:, 1:].max(axis=1) if (target == 0).any() else np.zeros(1)
    model.threshold = float(np.clip(np.quantile(false, 0.999) + 0.01, 0.5, 0.9))
    return model


def scan(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_licences (paragraphs), families, family (most probable), probability, template_share.

    At most ``rows`` documents, chosen by hash, give the ordinary paragraphs for fitting, those of more than ``chars`` code points
    none; every text is scanned whole.
    """
    # Ids first, from the one column: a sort that carried texts would send some from every partition to the driver.
    chosen = docs.select("doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows).distinct()
    some = docs.filter(F.char_length("text") <= chars).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    shared = docs.sparkSession.sparkContext.broadcast(train([r["text"] for r in sorted(some.collect(), key=lambda r: r["doc_id"])], seed))  # under 1 MB

    @F.pandas_udf(T.StructType([*fields("n_licences int, family string, probability double, template_share double").fields, T.StructField("families", T.ArrayType(T.StringType()))]))
    def scanned(texts: pd.Series) -> pd.DataFrame:
        out = []
        for hits in shared.value.scan(list(texts)):
            top = max(hits, key=lambda x: (x[1], x[2], x[0])) if hits else (None, None, None)
            out.append((len(hits), *top, sorted({x[0] for x in hits})))
        trim()
        return pd.DataFrame(out, columns=["n_licences", "family", "probability", "template_share", "families"])

    return docs.select("doc_id", scanned("text").alias("s")).select("doc_id", "s.*")
