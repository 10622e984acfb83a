"""Licence notices in documents: a trained classifier of passages, confirmed against templates.

Paragraphs are read in overlapping windows, which are turned into word 1- and 2-grams. A
multinomial logistic regression over the n-grams of the notices gives each licence family, and
the classes of other licences and of plain prose, a calibrated probability. A family stands if
enough of one of its notices is found in a window, beyond what other families of that window
explain, with the name and the version that tell it from licences of like notices. What the classifier takes for a licence and no
family stands for counts as unknown. Paragraphs are left out unread only where too little of every notice can be in them.
The data's path is column expressions and joins with the weight table, whose size the notices fix.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common notices by licence family: short forms, standard file headers and the telling paragraphs of full texts (fixed values).
NOTICES = {
    "agpl-3.0": [
        "licensed under the GNU Affero General Public License version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "released under AGPL 3.0", "SPDX-License-Identifier: AGPL-3.0-only", "licensed under the AGPLv3", "License: AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "apache-2.0": [
        "licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0", "License: Apache-2.0", "Apache License, Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "licensed under the BSD license", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "released under the 3-clause BSD license", "distributed under the 2-clause BSD license", "SPDX-License-Identifier: BSD-3-Clause", "License: BSD",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by": ["licensed under CC BY 4.0", "this work is licensed under a Creative Commons Attribution 4.0 International License", "available under the Creative Commons Attribution license", "License: CC BY 4.0"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0", "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "available under CC BY-NC-SA 4.0", "licensed under CC BY-NC-ND 4.0"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0", "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "text is available under the Creative Commons Attribution-ShareAlike License", "License: CC BY-SA 4.0"],
    "cc0": ["released under CC0 1.0 Universal", "dedicated to the public domain under CC0", "to the extent possible under law the author has waived all copyright and related rights", "SPDX-License-Identifier: CC0-1.0"],
    "gpl-2.0": [
        "licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "released under the GPL v2", "SPDX-License-Identifier: GPL-2.0-only", "licensed under the GPLv2", "License: GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 only, as published by the Free Software Foundation.",
    ],
    "gpl-3.0": [
        "this work is licensed under the GNU General Public License, version 3", "either version 3 of the License, or at your option any later version of the GNU General Public License", "released under the GPL v3", "SPDX-License-Identifier: GPL-3.0-or-later", "licensed under the GPLv3", "License: GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": ["licensed under the ISC License", "permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC", "License: ISC", "provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl": [
        "licensed under the GNU Lesser General Public License, version 3", "under the terms of the GNU Lesser General Public License version 2.1", "released under the LGPL", "SPDX-License-Identifier: LGPL-2.1-only", "License: LGPL-3.0", "licensed under the LGPLv2.1", "licensed under the LGPLv3",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "released under the MIT License", "licensed under the MIT license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "License: MIT", "The MIT License (MIT)", "MIT License Copyright (c)",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    ],
    "mpl-2.0": ["licensed under the Mozilla Public License, version 2.0", "this source code form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "License: MPL-2.0"],
    "proprietary": ["all rights reserved, no part may be reproduced without prior written permission", "proprietary and confidential, unauthorized copying of this file is strictly prohibited", "No part of this publication may be reproduced, stored or transmitted in any form without the prior permission of the publisher."],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the Unlicense", "SPDX-License-Identifier: Unlicense"],
}
#: Grants and mentions of licences that are no family here (fixed values).
OTHER_LICENCES = [
    "it lies in the public domain", "this work is in the public domain", "licensed under the Example Vendor Public Terms, version 7", "released under the Acme Community License", "this work is licensed under a custom agreement with the publisher", "licensed under the Artistic License 2.0", "made available under the Eclipse Public License, version 2.0", "licensed under the European Union Public Licence, version 1.2",
    "distributed under the Boost Software License, version 1.0", "released under the zlib License", "this font is licensed under the SIL Open Font License, version 1.1", "use of this source code is governed by the Microsoft Public License", "released under the terms of the WTFPL", "licensed under the Open Software License, version 3.0",
    "licensed under the Business Source License 1.1", "the Server Side Public License applies to this version", "available under the Open Database License", "licensed under the Foo Bar License", "my licence expired", "the licence of this work has expired", "see the LICENSE file for the terms of use", "License: see LICENSE file", "this file is covered by the licence agreement of the vendor",
    "the use of this material is subject to a licence of the owner", "this program is made available under the terms of the Common Development and Distribution License", "License: proprietary terms of Example Inc", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: BSL-1.0", "licensed under the terms of the Open Government Licence", "distributed under the PHP License, version 3.01", "licensed under the Python Software Foundation License",
]
#: Prose that names licences or rights but grants none, and what stands beside notices of every kind (fixed values).
PROSE = [
    "he lost his driving licence after the accident", "the licence fee was raised again this year", "she asked for permission to leave the room early", "the copyright debate in parliament went on", "our copyright debate in parliament went on", "the warranty on the car has expired", "a software licence is a legal instrument", "the public domain is a concept in law", "the council granted a licence to sell food",
    "licensed premises must close at midnight", "the company redistributed its profits", "all rights of the workers were respected", "under the terms of the treaty the border was open", "distributed under the rules of the archive, version 2", "a general permission to fish in the lake was published by the council", "the foundation gave a free copy of the book to any person who asked", "the author has a work in the public library",
    "no person may copy the key without written notice", "the law of the land permits the use of the common", "version 3 of the report was published later", "the commons were creative and the public was free", "an attribution of the painting to the school is under debate", "the conditions of the contract were met in full", "the terms of the loan are strictly confidential", "any use of the hall is subject to a fee",
    "copies of the documentation were distributed to the associated press", "Copyright (c) 2020 Jane Doe. All rights reserved.", "Copyright 2019 The Example Authors. All rights reserved.", "Copyright (C) 2015-2021 Example Inc.", "the copyright of the song belongs to the heirs", "the court held that copyright in the photograph had lapsed", "they renewed the fishing licence for another season", "a pilot must hold a valid licence", "the dog licence was abolished in that year",
    "the broadcaster is paid for by the licence fee", "the minister gave permission for the march", "we asked the landlord for permission to paint", "he was copying the letter by hand", "an expired driving licence must be renewed at the office", "the licence plate of the car was stolen", "poetic licence allowed the author to change the dates", "the club lost its liquor licence", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES", "You should have received a copy of the License along with this program. If not, write to the Foundation.", "the author and the publisher thank the library for permission to print the map",
]
OTHER = OTHER_LICENCES + PROSE
#: A licence that is no family here, and text that grants none.
UNKNOWN, PLAIN = "unknown", "none"
#: A paragraph with one of these is read, for it may name a licensing matter; every notice holds one.
CUES = ("licen", "copyright", "copying", "permission", "redistribut", "public domain", "creative commons", "spdx", "rights reserved", "gpl", "cc0", "cc by", "cc-by")
#: What a window must hold for a family to stand: of each group one n-gram. Names and versions that stand in otherwise equal notices (fixed values).
NEEDED = {
    "agpl-3.0": [("affero general", "agpl", "agplv3")],
    "cc-by-nc": [("by nc", "attribution noncommercial")],
    "cc-by-sa": [("by sa", "attribution sharealike")],
    "gpl-2.0": [("gnu general", "gpl", "gplv2"), ("version 2", "gpl 2.0", "gpl v2", "gplv2")],
    "gpl-3.0": [("gnu general", "gpl", "gplv3"), ("version 3", "gpl 3.0", "gpl v3", "gplv3")],
    "lgpl": [("lesser general", "library general", "lgpl", "lgplv2.1", "lgplv3")],
}
#: Words by which a window is read though no notice is near, for a licence that is no family.
CUE_WORDS = ("license", "licence", "licensed", "licenced", "licenses", "licences", "copyright", "copyrighted", "spdx", "redistributed", "redistribution")
#: Words that the gate takes last, for they are in most texts.
COMMON = frozenset("a all any as at be by for has in into is it later not of on or other part source that the this to under version with without you your".split())
#: Words of a window and from one to the next: a notice (32 words at most) lies in one of them whole.
WINDOW, STRIDE = 64, 32
_WORD = r"[a-z0-9]+(?:[.+][a-z0-9]+)*"


def ngrams(text: str) -> list[str]:
    """Distinct word 1- and 2-grams of the lower-cased text, in order of first use."""
    words = re.findall(_WORD, text.lower())
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


def is_named(family: str, grams: list[str]) -> bool:
    """Whether n-grams hold the name and the version that the family needs."""
    return all(any(g in grams for g in group) for group in NEEDED.get(family, ()))


@dataclass(frozen=True)
class LicenceModel:
    classes: tuple[str, ...]
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    temperature: float


def _samples(seed: int, copies: int, fold: int | None = None, folds: int = 5) -> list[tuple[str, str]]:
    """Notices and other prose, cropped, with words dropped and strange words around; what lost the name or version of its family is of an unknown licence.

    With a fold, only those whose number in their class falls in it; with -1 - fold, only the others.
    """
    r = random.Random(seed)
    strange = lambda k: " ".join("".join(r.choices("abcdefghilmnoprstuvy", k=r.randint(2, 8))) for _ in range(k))
    taken = lambda i: fold is None or (i % folds == fold if fold >= 0 else i % folds != -1 - fold)
    out = []
    for name, texts in [*NOTICES.items(), (UNKNOWN, OTHER_LICENCES), (PLAIN, PROSE)]:
        for text in (t for i, t in enumerate(texts) if taken(i)):
            for k in range(copies):
                words = text.split()
                if k and name in (UNKNOWN, PLAIN):
                    words = [w for w in words if r.random() > 0.15]
                elif k:
                    words = [w for w in words if r.random() > 0.04]
                    if len(words) > 20 and r.random() < 0.3:  # as where a window ends within it
                        size = r.randint(len(words) // 2, len(words))
                        at = r.randint(0, len(words) - size)
                        words = words[at : at + size]
                label = name if is_named(name, ngrams(" ".join(words))) else UNKNOWN
                out.append((f"{strange(r.choice([0, 0, 1, 4, 12]))} {' '.join(words)} {strange(r.choice([0, 0, 1, 4, 12]))}", label))
    common = sorted({w for texts in [*NOTICES.values(), OTHER] for t in texts for w in re.findall(_WORD, t.lower())})
    out += [(" ".join(r.choices(common, k=r.randint(1, 12))) + " " + strange(4), PLAIN) for _ in range(copies * 40)]
    out += [(strange(r.randint(3, 30)), PLAIN) for _ in range(copies * 10)]
    return out


@lru_cache(maxsize=1)
def default_model(rounds: int = 120, ridge: float = 2e-4, folds: int = 5) -> LicenceModel:
    """Softmax regression on the sample; the temperature is set on notices and prose that a fit on the other folds has not seen.

    Each fold leaves out every fifth notice of each class.
    """
    vocabulary = {g: i for i, g in enumerate(dict.fromkeys(g for texts in [*NOTICES.values(), OTHER] for t in texts for g in ngrams(t)))}
    classes = (*sorted(NOTICES), UNKNOWN, PLAIN)

    def matrix(samples: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(samples), len(vocabulary) + 1), np.float32)
        x[:, -1] = 1
        for i, (text, _) in enumerate(samples):
            x[i, [vocabulary[g] for g in ngrams(text) if g in vocabulary]] = 1
        return x, np.array([classes.index(c) for _, c in samples])

    def chances(logits: np.ndarray) -> np.ndarray:
        raised = np.exp(logits - logits.max(axis=1, keepdims=True))
        return raised / raised.sum(axis=1, keepdims=True)

    def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        target = np.eye(len(classes), dtype=np.float32)[y]
        w = np.zeros((x.shape[1], len(classes)), np.float32)
        first, second = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, rounds + 1):
            slope = x.T @ (chances(x @ w) - target) / len(y) + ridge * w
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            w -= 0.08 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        return w

    unseen = [(x @ fitted(*matrix(_samples(3, 4, -1 - k, folds))), y) for k in range(folds) for x, y in [matrix(_samples(17, 2, k, folds))]]
    logits, y = np.concatenate([u for u, _ in unseen]), np.concatenate([y for _, y in unseen])
    grid = np.exp(np.linspace(-1.5, 1.5, 61))
    temperature = float(min(grid, key=lambda s: -np.log(chances(logits / s)[np.arange(len(y)), y] + 1e-12).mean()))
    w = fitted(*matrix(_samples(3, 8)))
    return LicenceModel(classes, tuple(w[-1].tolist()), {g: tuple(w[i].tolist()) for g, i in vocabulary.items()}, temperature)


def _notice_parts() -> list[tuple[str, str, str, float]]:
    """(n-gram, family, notice, part of the notice): an n-gram of many families tells little."""
    families: dict[str, set[str]] = {}
    for family, texts in NOTICES.items():
        for gram in {g for t in texts for g in ngrams(t)}:
            families.setdefault(gram, set()).add(family)
    telling = {g: 1 / len(f) for g, f in families.items()}
    return [(g, family, f"{family} {k}", telling[g] / sum(telling[x] for x in ngrams(t))) for family, texts in sorted(NOTICES.items()) for k, t in enumerate(texts) for g in ngrams(t)]


def gate_words(least_share: float) -> list[str]:
    """Words of which each text that holds least_share of some notice holds one.

    Per notice, long words that carry much of it are taken until the n-grams that hold none
    of them are less than the share.
    """
    notices: dict[str, dict[str, float]] = {}
    for gram, _, notice, part in _notice_parts():
        notices.setdefault(notice, {})[gram] = part
    chosen: dict[str, None] = {}
    for parts in notices.values():
        left = {g: x for g, x in parts.items() if not set(g.split(" ")) & set(chosen)}
        while left and sum(left.values()) >= least_share - 1e-6:
            weight: dict[str, float] = {}
            for g, x in left.items():
                for word in set(g.split(" ")):
                    weight[word] = weight.get(word, 0.0) + x
            word = max(sorted(weight), key=lambda w: (w not in COMMON, weight[w] * len(w)))
            chosen[word] = None
            left = {g: x for g, x in left.items() if word not in g.split(" ")}
    return list(chosen)


def _tables(spark, model: LicenceModel) -> tuple[DataFrame, DataFrame]:
    """n-gram -> weights; n-gram -> the notices that hold it. Their size is that of the notices."""
    weights = spark.createDataFrame(sorted(model.weights.items()), "gram string, weights array<double>")
    held = spark.createDataFrame(_notice_parts(), "gram string, family string, notice string, part double")
    return weights, held.groupBy("gram").agg(F.collect_list(F.struct("gram", "family", "notice", "part")).alias("notices"))


def _has_any(text: Column, cues: list[str] | tuple[str, ...]) -> Column:
    def test(lowered: Column) -> Column:
        found = F.lit(False)
        for cue in cues:
            found = found | lowered.contains(cue)
        return found

    return F.exists(F.array(F.lower(text)), test)  # as a lambda's variable the lowered text is made once


def _gate(text: Column, least_share: float) -> Column:
    """Whether a text is read: one that fails this has no cue and can hold least_share of no notice."""
    if least_share <= 0:
        return F.lit(True)
    # a word that holds another one needs no test of its own
    tests = list(dict.fromkeys([*CUES, *gate_words(least_share)]))
    return _has_any(text, [t for t in tests if not any(o != t and o in t for o in tests)])


def _text_gate(least_share: float) -> Column:
    """_gate() of a whole text, whose lines are not joined yet."""
    return _gate(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), least_share)


def _families(model: LicenceModel, least_probability: float, least_share: float) -> Column:
    """The confirmed families of a window with its logits, likeliest class (family) and matched n-grams.

    The likeliest family comes first, then notices by the number of their n-grams found. What
    the notices before explain counts neither for nor against a notice of another family.
    """
    part = lambda entries: F.aggregate(entries, F.lit(0.0), lambda a, m: a + m["part"])
    place = F.create_map(*[F.lit(x) for i, c in enumerate(model.classes) for x in (c, i)])
    neither = F.greatest(*[F.get("logits", F.lit(model.classes.index(c))) for c in (UNKNOWN, PLAIN)])
    against = lambda family: F.get("logits", F.try_element_at(place, family)) - neither
    odds = float(np.log(least_probability / (1 - least_probability))) if 0 < least_probability < 1 else (-np.inf if least_probability <= 0 else np.inf)
    own = lambda n: F.filter("matched", lambda m: m["notice"] == n)
    found = F.transform(F.array_distinct(F.transform("matched", lambda m: m["notice"])), lambda n: F.struct(n.alias("notice"), own(n).alias("entries")))
    rated = F.transform(
        found,
        lambda x: F.struct(
            F.when(x["entries"][0]["family"] == F.col("family"), 0).otherwise(1).alias("late"),
            (-F.size(x["entries"])).alias("size"),
            x["notice"].alias("notice"),
            x["entries"][0]["family"].alias("family"),
            part(x["entries"]).alias("share"),
            x["entries"].alias("entries"),
        ),
    )
    likely = lambda x: ((x["late"] == 0) | ((x["share"] >= least_share - 1e-9) & (against(x["family"]) >= F.lit(odds))))

    def holds(grams: tuple[str, ...]) -> Column:
        return F.exists("matched", lambda m: m["gram"].isin(*grams))

    def is_named_row(x: Column) -> Column:
        test = F.lit(True)
        for family, grams in ((f, g) for f, groups in NEEDED.items() for g in groups):
            test = test & ((x["family"] != family) | holds(grams))
        return test

    def step(state: Column, x: Column) -> Column:
        explained = part(F.filter(x["entries"], lambda m: F.array_contains(state["grams"], m["gram"])))
        first = (x["late"] == 0) & (F.col("probability") >= least_probability) & (x["share"] >= least_share)
        first = first & ~F.col("family").isin(UNKNOWN, PLAIN) & is_named_row(x)
        other = (x["late"] == 1) & is_named_row(x) & (x["share"] - explained >= F.lit(least_share) * (F.lit(1.0) - explained)) & (explained < 1 - 1e-9)
        stands = first | other | F.array_contains(state["families"], x["family"])
        grams = F.when(stands | (x["late"] == 0), F.concat(state["grams"], F.transform(x["entries"], lambda m: m["gram"]))).otherwise(state["grams"])
        families = F.when(first | other, F.array_union(state["families"], F.array(x["family"]))).otherwise(state["families"])
        return F.struct(families.alias("families"), grams.alias("grams"))

    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("families"), empty.alias("grams"))
    return F.aggregate(F.array_sort(F.filter(rated, likely)), start, step)["families"]


def notices(docs: DataFrame, model: LicenceModel | None = None, least_probability: float = 0.5, least_share: float = 0.6) -> DataFrame:
    """documents -> (row_id, doc_id, paragraph, family, probability, share, confirmed, families, licence), one row per paragraph that is read.

    paragraph: number of the paragraph in its text from 0. A line belongs to the line before it
    unless that is blank or ends a sentence; comment marks in front of it are passed over. Paragraphs that have no cue and can hold least_share of no
    notice are not read, but the first one has a row in any case. families: all families confirmed in a window of the paragraph, in
    order; confirmed: whether there is one; family, probability, share: those of the window
    whose likeliest class (the first by name on a tie) is confirmed with the greatest
    probability, else of the one with most of a notice. share: of the best-matching notice of
    that family, the part of its n-grams found, each weighted by one over the families that use
    it. The likeliest family needs both thresholds, another one its probability against
    unknown alone and its share without n-grams that the families before it explain.
    licence: the greatest calibrated probability, over the paragraph's windows, that a window is of any class but plain prose.
    """
    model = model or default_model()
    spark = docs.sparkSession
    weights, held = _tables(spark, model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(_text_gate(least_share))
    whole = texts.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.regexp_replace("text", r"(?<=[^.!?:\s][ \t\r]{0,9})\n[ \t]{0,99}(?:[#*;%]{1,9}|/{2,9}|-{2,9})?[ \t]{0,99}(?=[\p{L}\p{N}(\"'])", " ").alias("text"))
    units = whole.select("row_id", "doc_id", F.posexplode(F.split("text", r"\n+")).alias("paragraph", "text")).where((F.col("paragraph") == 0) | _gate(F.col("text"), least_share))
    words = units.select("row_id", "doc_id", "paragraph", _has_any(F.col("text"), CUES).alias("cue"), F.regexp_extract_all(F.lower("text"), F.lit(_WORD), 0).alias("words"))
    if least_share > 0:  # gate words as whole words
        read = F.col("cue") | F.arrays_overlap("words", F.array(*[F.lit(w) for w in gate_words(least_share)]))
        words = words.where((F.col("paragraph") == 0) | read).withColumn("words", F.when(read, F.col("words")).otherwise(F.array().cast("array<string>")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW + STRIDE - 1, F.lit(0)), F.lit(STRIDE))
    windows = words.select("row_id", "doc_id", "paragraph", F.posexplode(F.transform(starts, lambda a: F.slice("words", a + 1, WINDOW))).alias("window", "words"))
    if least_share > 0:  # a window without a gate word confirms nothing; the first stands for a paragraph of no others
        windows = windows.where((F.col("window") == 0) | F.arrays_overlap("words", F.array(*[F.lit(w) for w in dict.fromkeys([*gate_words(least_share), *CUE_WORDS])])))
    pairs = F.filter(F.transform("words", lambda w, i: F.concat(w, F.lit(" "), F.get("words", i + 1))), lambda g: g.isNotNull())
    key = ["row_id", "doc_id", "paragraph", "window"]
    grams = windows.select(*key, F.explode_outer(F.array_distinct(F.concat("words", pairs))).alias("gram"))
    found = grams.join(F.broadcast(weights), "gram", "left").join(F.broadcast(held), "gram", "left")
    sums = [F.sum(F.coalesce(F.get("weights", F.lit(k)), F.lit(0.0))).alias(f"s{k}") for k in range(len(model.classes))]
    scored = found.groupBy(*key).agg(*sums, F.flatten(F.collect_list("notices")).alias("matched"))
    logits = F.array(*[(F.col(f"s{k}") + F.lit(b)) / F.lit(model.temperature) for k, b in enumerate(model.bias)])
    chosen = scored.withColumn("logits", logits).withColumn("top", F.array_max("logits"))
    total = F.aggregate(F.transform("logits", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)
    names = F.array(*[F.lit(c) for c in model.classes])
    named = chosen.select(*key, F.get(names, (F.array_position("logits", F.col("top")) - 1).cast("int")).alias("family"), (F.lit(1.0) / total).alias("probability"), (1 - F.exp(F.get("logits", F.lit(model.classes.index(PLAIN))) - F.col("top")) / total).alias("licence"), "logits", "matched")
    own = F.filter("matched", lambda m: m["family"] == F.col("family"))
    parts = lambda notice: F.aggregate(F.filter("own", lambda m: m["notice"] == notice), F.lit(0.0), lambda a, m: a + m["part"])
    shares = F.transform(F.array_distinct(F.transform("own", lambda m: m["notice"])), parts)
    measured = named.withColumn("own", own).withColumn("share", F.coalesce(F.array_max(shares), F.lit(0.0))).withColumn("families", _families(model, least_probability, least_share))
    stands = F.array_contains("families", F.col("family"))
    rank = F.struct(stands, F.when(stands, F.col("probability")).otherwise(F.col("share")), -F.col("window"))
    best = measured.groupBy("row_id", "doc_id", "paragraph").agg(
        F.max_by(F.struct("family", "probability", "share"), rank).alias("best"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"),
        F.max("licence").alias("licence"),
    )
    return best.select("row_id", "doc_id", "paragraph", "best.family", "best.probability", "best.share", (F.size("families") > 0).alias("confirmed"), "families", "licence")


def scan(docs: DataFrame, model: LicenceModel | None = None, least_probability: float = 0.5, least_share: float = 0.6) -> DataFrame:
    """documents -> (doc_id, families, n_notices, n_unknown, probability), one row per document row.

    families: confirmed families in order, comma-joined, '' if none; n_notices: confirmed
    paragraphs; n_unknown: paragraphs without a confirmed family that the classifier takes, with a probability
    of least_probability or more, for a licence of whatever class; probability: the
    greatest of the confirmed ones, null if none. Null and empty texts have no paragraphs.
    Repeated rows are scanned each. An empty table gives an empty result. Other columns are
    not looked at.
    """
    found = notices(docs, model, least_probability, least_share).groupBy("row_id", "doc_id").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))), ",").alias("families"),
        F.count_if("confirmed").alias("n_notices"),
        F.count_if((F.col("licence") >= least_probability) & ~F.col("confirmed")).alias("n_unknown"),
        F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"),
    )
    zero = F.lit(0).cast("long")
    rest = docs.where(~_text_gate(least_share)).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("families"), zero.alias("n_notices"), zero.alias("n_unknown"), F.lit(None).cast("double").alias("probability"))
    return found.drop("row_id").unionByName(rest)
