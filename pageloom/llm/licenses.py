"""Licence notices in documents: a trained paragraph classifier, confirmed by notice templates.

Paragraphs are lines, and runs of neighbouring lines that hold more of a template than each shorter
run in them: notices are often wrapped. Features are words and pairs of words; a multinomial logistic regression over
them knows the licence families and an ``unknown`` class, learned from corpus paragraphs and from
sentences that talk of licences without granting one. Its probabilities are calibrated by a
temperature, and the least probability of a family by a bound on false alarms. A prediction counts
only if the paragraph also holds most word pairs of one of the family's templates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.words import HashIndex, Hasher, Texts, mix, plain_words, text_chunks, text_udf, words_of
from pageloom.session import ship_by_value

ship_by_value(__name__)

UNKNOWN = "unknown"

# fixed values: usual short notices of each family
TEMPLATES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License version 3", "GNU AGPL v3", "AGPL-3.0 license"],
    "Apache-2.0": ["licensed under the Apache License, Version 2.0", "released under the Apache 2.0 license", "under the terms of the Apache License 2.0"],
    "BSD": ["licensed under the BSD 3-Clause License", "released under the BSD 2-Clause License", "redistribution and use in source and binary forms, with or without modification, are permitted", "licensed under the BSD license"],
    "CC-BY": ["licensed under a Creative Commons Attribution 4.0 International License", "licensed under CC BY 4.0"],
    "CC-BY-NC": ["licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA": ["licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["dedicated to the public domain under CC0 1.0", "released under CC0 1.0 Universal public domain dedication"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2", "released under the GPL v2"],
    "GPL-3.0": ["licensed under the GNU General Public License, version 3", "this program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "released under the GPL v3"],
    "ISC": ["licensed under the ISC License", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["licensed under the GNU Lesser General Public License", "released under the LGPL version 3"],
    "MIT": ["released under the MIT License", "licensed under the MIT license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "MPL-2.0": ["licensed under the Mozilla Public License, version 2.0", "subject to the terms of the Mozilla Public License, v. 2.0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "released under the Unlicense"],
}
# fixed values: sentences of the unknown class
OTHER = [
    "a driving license is needed to rent a car", "the license fee was raised by the council", "all rights reserved",
    "the license plate was found by the road", "a fishing license for the lake costs little", "see the license agreement for details",
    "they work under the general manager of the public library", "the version was released under pressure", "the university of the city",
    "poetic license is granted to the author", "the permission was granted by the teacher", "copyright of the publisher",
]
LEADS = ["", "this work is", "this file is", "the code is", "all content on this site is", "copyright 2019 the authors.", "note:", "this dataset is", "software"]
TAILS = ["", ".", ". see the LICENSE file", "; see the file for details", ". all other rights reserved"]

#: Corpus documents whose paragraphs teach the unknown class, by a hash of the id.
SAMPLE_DOCS = 1000
#: Longer paragraphs aren't used for learning; the search reads paragraphs of any length.
LEARNED_CHARS = 2000
ROUNDS = 250
#: Share of unknown training paragraphs that may reach a family.
FALSE_ALARMS = 0.001
LEAST_OVERLAP = 0.6
#: Words of a run's first and last line, and of all lines between, at most: twice the longest template.
RUN_WORDS = 2 * max(len(t.split()) for texts in TEMPLATES.values() for t in texts)

FOUND = "array<struct<paragraph: int, family: string, probability: double>>"


def paragraphs(texts: Texts) -> Texts:
    """The same bytes, one row per line."""
    breaks = np.flatnonzero(texts.data == 10) + 1
    return Texts(0, texts.data, np.unique(np.r_[texts.offsets, breaks]))


def grams(texts: Texts, table: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and hashes of words, and of pairs of neighbouring words."""
    words = words_of(texts, table, hasher)
    same = words.row[1:] == words.row[:-1]
    pairs = mix(words.hash[:-1] * np.uint64(3) + words.hash[1:])[same]
    return words.row, words.hash, words.row[1:][same], pairs


def _texts(rows: list[str]) -> Texts:
    parts = list(text_chunks(pa.array(rows, pa.string()), limit=1 << 40))
    return parts[0] if parts else Texts(0, np.empty(0, np.uint8), np.zeros(1, np.int64))


class Classifier:
    """Weights per feature hash and class (the last one unknown), temperature, least probability, and template pairs."""

    def __init__(self, paragraphs_: list[str], seed: int = 7) -> None:
        self.families = sorted(TEMPLATES)
        table, hasher = plain_words(), Hasher()
        row, _, prow, pairs = grams(_texts([t for f in self.families for t in TEMPLATES[f]]), table, hasher)
        self.template_family = np.repeat(np.arange(len(self.families)), [len(TEMPLATES[f]) for f in self.families])
        self.template_pairs = [np.unique(pairs[prow == k]) for k in range(len(self.template_family))]
        self.pairs = np.unique(pairs)
        random = np.random.default_rng(seed)
        rows, target = [], []
        for k, family in enumerate(self.families):
            for template in TEMPLATES[family]:
                for lead in LEADS:
                    for tail in TAILS:
                        rows.append(f"{lead} {template}{tail}")
                        target.append(k)
        for text in OTHER:
            for tail in TAILS:
                rows.append(text + tail)
                target.append(len(self.families))
        rows += paragraphs_
        target += [len(self.families)] * len(paragraphs_)
        target = np.array(target)
        r, c = self._pairs_of(rows, table, hasher)
        test = random.random(len(rows)) < 0.25
        mine = ~test[r]
        self.weights, self.bias = self._fit(r[mine], c[mine], target, ~test)
        raw = self.logits(r, c, len(rows))
        # the temperature that explains the paragraphs best which the fit hasn't seen
        scale = np.geomspace(0.25, 8, 25)
        loss = [-np.log(self._softmax(raw[test] / t)[np.arange(test.sum()), target[test]] + 1e-12).mean() for t in scale]
        self.temperature = float(scale[int(np.argmin(loss))])
        unknown = self._softmax(raw / self.temperature)[target == len(self.families)][:, :-1].max(axis=1)
        self.least = float(max(0.5, np.quantile(unknown, 1 - FALSE_ALARMS))) if len(unknown) else 0.5

    def _pairs_of(self, rows, table, hasher):
        row, words, prow, pairs = grams(_texts(rows), table, hasher)
        r, h = np.r_[row, prow], np.r_[words, pairs]
        keys, counts = np.unique(h, return_counts=True)
        self.hashes = keys[counts > 1]
        at = HashIndex(self.hashes).find(h)
        both = np.unique(r[at >= 0] * len(self.hashes) + at[at >= 0])
        return both // len(self.hashes), both % len(self.hashes)

    def _fit(self, r, c, target, used):
        n, classes = len(target), len(self.families) + 1
        w, b = np.zeros((len(self.hashes), classes)), np.zeros(classes)
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
        goal = np.eye(classes)[target] * used[:, None]
        for i in range(1, ROUNDS + 1):
            p = self._softmax(self._sum(r, c, w, n) + b) * used[:, None]
            d = (p - goal) / used.sum()
            g = np.stack([np.bincount(c, weights=d[r, k], minlength=len(w)) for k in range(classes)], axis=1) + 1e-4 * w
            gb = d.sum(axis=0)
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w -= 0.05 * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.99 ** i)) + 1e-8)
            b -= 0.05 * (mb / (1 - 0.9 ** i)) / (np.sqrt(vb / (1 - 0.99 ** i)) + 1e-8)
        return w, b

    @staticmethod
    def _sum(r, c, w, n):
        return np.stack([np.bincount(r, weights=w[c, k], minlength=n) for k in range(w.shape[1])], axis=1)

    def logits(self, r, c, n):
        return self._sum(r, c, self.weights, n) + self.bias

    @staticmethod
    def _softmax(x):
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def wrapped(self, line: np.ndarray, hashes: np.ndarray, doc: np.ndarray, known: HashIndex) -> list[tuple[int, int, int, int]]:
        """Runs of neighbouring lines whose words hold enough of a template, and more than the run without its first or last line.

        ``line`` and ``doc`` are those of each word. Gives (first word, end, first line, last line), shorter runs first.
        """
        if len(line) < 2:
            return []
        pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
        at = known.find(pairs)
        at[(doc[1:] != doc[:-1]) | (line[1:] - line[:-1] > 1)] = -1
        places = np.flatnonzero(at >= 0)
        pair = at[places]
        inside = np.stack([np.isin(self.pairs, t) for t in self.template_pairs], axis=1)
        need = np.maximum(np.array([len(t) for t in self.template_pairs]), 1)
        lines, first = np.unique(line, return_index=True)
        end, owner = np.r_[first[1:], len(line)], doc[first]
        block = np.cumsum(np.r_[True, (lines[1:] - lines[:-1] > 1) | (owner[1:] != owner[:-1])])
        flagged = np.zeros(len(lines), np.bool_)
        flagged[np.searchsorted(lines, np.r_[line[places], line[places + 1]])] = True

        def held(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            """Distinct pairs of each template between two words."""
            lo, hi = np.searchsorted(places, start), np.searchsorted(places, stop - 1)
            n = np.maximum(hi - lo, 0)
            which = np.repeat(lo + n - np.cumsum(n), n) + np.arange(n.sum())
            some = np.unique(np.repeat(np.arange(len(start)), n) * len(self.pairs) + pair[which])
            out = np.zeros((len(start), inside.shape[1]), np.int64)
            np.add.at(out, some // len(self.pairs), inside[some % len(self.pairs)])
            return out

        out = []
        i, step = np.flatnonzero(flagged), 1
        while len(i):
            i = i[i + step < len(lines)]
            i = i[(block[i + step] == block[i]) & (first[i + step] - end[i] <= RUN_WORDS)]
            a = i[flagged[i + step]]
            b = a + step
            start, stop = np.maximum(first[a], end[a] - RUN_WORDS), np.minimum(end[b], first[b] + RUN_WORDS)
            whole = held(start, stop)
            more = (whole > held(first[a + 1], stop)) & (whole > held(start, end[b - 1])) & (whole >= LEAST_OVERLAP * need)
            for k in np.flatnonzero(more.any(axis=1)):
                out.append((int(start[k]), int(stop[k]), int(lines[a[k]]), int(lines[b[k]])))
            step += 1
        return out

    def explained(self, pairs: np.ndarray, family: int) -> tuple[float, np.ndarray]:
        """Overlap with the family's best template, and the pairs in common with it."""
        each = [(float(np.isin(t, pairs).mean()), k) for k, (t, f) in enumerate(zip(self.template_pairs, self.template_family)) if f == family and len(t)]
        share, k = max(each, default=(0.0, -1))
        return share, np.intersect1d(self.template_pairs[k], pairs) if k >= 0 else pairs[:0]

    def finder(self):
        table, hasher = plain_words(), Hasher()
        features, known_pairs = HashIndex(self.hashes), HashIndex(self.pairs)

        def find(texts: Texts) -> pa.Array:
            lines = paragraphs(texts)
            row, words, prow, pairs = grams(lines, table, hasher)
            # a paragraph without any pair of a template can't be confirmed, whatever its probability
            some = np.unique(prow[known_pairs.find(pairs) >= 0])
            hits = []  # (first line, last line, family, probability, overlap, pairs in common)

            def judge(r, h, n):
                at = features.find(h)
                both = np.unique(r[at >= 0] * len(self.hashes) + at[at >= 0])
                p = self._softmax(self.logits(both // len(self.hashes), both % len(self.hashes), n) / self.temperature)
                best = p[:, :-1].argmax(axis=1)
                return best, p, np.flatnonzero((p.argmax(axis=1) < p.shape[1] - 1) & (p[:, :-1].max(axis=1) >= self.least))

            if len(some):
                place = np.full(lines.rows, -1)
                place[some] = np.arange(len(some))
                r, h = np.r_[place[row], place[prow]], np.r_[words, pairs]
                best, p, sure = judge(r[r >= 0], h[r >= 0], len(some))
                for k in sure:
                    share, common = self.explained(pairs[prow == some[k]], best[k])
                    if share >= LEAST_OVERLAP:
                        hits.append((int(some[k]), int(some[k]), int(best[k]), float(p[k, best[k]]), share, common))
            doc_of = np.searchsorted(texts.offsets, lines.offsets[:-1], side="right") - 1
            runs = self.wrapped(row, words, doc_of[row], known_pairs)
            if runs:
                across = [mix(words[a:b - 1] * np.uint64(3) + words[a + 1:b]) for a, b, _, _ in runs]
                mine = [np.r_[words[a:b], x] for (a, b, _, _), x in zip(runs, across)]
                best, p, sure = judge(np.repeat(np.arange(len(runs)), [len(m) for m in mine]), np.concatenate(mine), len(runs))
                for k in sure:
                    (_, _, i, j), family = runs[k], int(best[k])
                    share, common = self.explained(across[k], family)
                    touched = [x for x in hits if x[0] <= j and x[1] >= i]
                    # what a shorter run says of the same words with less of a template gives way
                    worse = [x for x in touched if x[4] < share and np.isin(x[5], common).all()]
                    if share < LEAST_OVERLAP or any(x[2] == family and not any(x is w for w in worse) for x in touched):
                        continue
                    # a run whose words some part explains as well adds nothing
                    if any(x[4] >= share and np.isin(common, x[5]).all() for x in touched):
                        continue
                    hits = [x for x in hits if not any(x is w for w in worse)] + [(i, j, family, float(p[k, family]), share, common)]
            out: list[list] = [[] for _ in range(texts.rows)]
            for i, _, family, probability, _, _ in sorted(hits, key=lambda x: x[:3]):
                first = int(np.searchsorted(lines.offsets, texts.offsets[doc_of[i]], side="left"))
                out[doc_of[i]].append({"paragraph": i - first, "family": self.families[family], "probability": probability})
            return pa.array(out, pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64())])))

        return find


def learn(docs: DataFrame) -> Classifier:
    """A classifier; paragraphs of about ``SAMPLE_DOCS`` documents without licence words teach the unknown class."""
    rows = docs.where("text is not null")
    n = rows.count()
    share = min(1.0, SAMPLE_DOCS / n) if n else 1.0
    sample = rows.where(F.pmod(F.xxhash64(F.lit("licenses"), "doc_id", F.length("text")), F.lit(1_000_000)) < share * 1_000_000)
    lines = sample.select(F.explode(F.split("text", "\n")).alias("line")).where((F.length("line") <= LEARNED_CHARS) &
        ~F.col("line").rlike(r"(?i)licen[sc]|copyright|public domain|hereby granted"))
    lines = lines.distinct().orderBy(F.xxhash64("line"), "line").limit(4 * SAMPLE_DOCS)
    return Classifier([r.line for r in lines.collect()])


def license_families(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_notices, families, notices)`` for each row of ``docs(doc_id, text)``.

    ``notices`` lists the paragraphs (lines from 0; of a wrapped notice the first) with family and probability; ``families`` joins
    the distinct families in order, and is ``unknown`` where there is none. Null and empty texts
    have no notices. Repeated rows each get their line; other columns aren't read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(learn(docs)))
    found = docs.withColumn("_f", text_udf(lambda: cloudpickle.loads(shared.value).finder(), FOUND)(F.col("text")))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("_f", lambda x: x["family"]))), ",")
    return found.select("doc_id", F.size("_f").cast("bigint").alias("n_notices"),
                        F.when(names == "", UNKNOWN).otherwise(names).alias("families"), F.col("_f").alias("notices"))
