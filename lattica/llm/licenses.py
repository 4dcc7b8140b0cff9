"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of words, line ends or not, as long as the template over the threshold (no longer than the text); a
block starts at every word. It meets a template of t distinct words if it holds o of them: ``ceil(threshold * t)``, or
all t where the template has fewer than ``WHOLE_UNDER`` (a short notice says too little otherwise).

Words of the templates are ordered by their frequency over the whole corpus, rarest first. A block that meets a template
holds one of its first t - o + 1 words (prefix filter), so only stretches of text around such words are looked at. A
stretch needs o different template words at all (length filter), and as its prefix words are met in order, their
number so far plus the lesser of what is left of the template and what is left of the stretch in that order must still
reach o (positional filter on both sides). In what survives the exact count of every window is taken, so the join is exact.

Templates are a fixed list, so their words, frequencies and prefixes go to every task whatever the corpus.

Defined results: a null text is an empty one and has no words; a null doc_id keeps its row; repeated rows are scanned
one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import map_texts
from lattica.session import table

# Word pattern, phrases and their labels.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices by which licenses are recognised, and their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2.0",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-clause",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "either version 3 of the license or at your option any later version": "gpl-3.0-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under the mozilla public license version 2 0": "mpl-2.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
    "all rights reserved": "reserved",
}
THRESHOLD, WHOLE_UNDER = 0.8, 10


def words_of(text: str | None) -> list[str]:
    """Words of the text with A-Z in lower case; other letters stay as they are."""
    text = text or ""
    return WORD.findall(text.lower() if text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def measures(notice: str, threshold: float) -> tuple[list[str], int, int]:
    """Distinct words of a template, how many of them a block needs, and how many words long a block is."""
    words = notice.split()
    own = sorted(set(words))
    if len(own) < WHOLE_UNDER:
        return own, len(own), len(words)
    return own, math.ceil(threshold * len(own) - 1e-9), math.ceil(len(words) / threshold - 1e-9)


class TemplateIndex:
    """Templates with words rarest first, which templates each prefix word may open, and how often the filters drop a stretch."""

    def __init__(self, frequency: dict[str, int], threshold: float = THRESHOLD):
        vocabulary = sorted({w for t in TEMPLATES for w in t.split()}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.labels = list(TEMPLATES.values())
        self.sets, self.need, self.width, self.order = [], [], [], []
        self.prefix: dict[str, list[int]] = {}
        self.dropped = Counter()
        for i, notice in enumerate(TEMPLATES):
            own, need, width = measures(notice, threshold)
            self.order.append(sorted(own, key=self.rank.__getitem__))
            self.sets.append(frozenset(own))
            self.need.append(need)
            self.width.append(width)
            for w in self.order[i][: len(own) - need + 1]:
                self.prefix.setdefault(w, []).append(i)

    def meet(self, words: list[str], known: set[str]) -> dict[int, float]:
        """template -> greatest containment in any block, for all templates that a block meets."""
        opened: dict[int, set[str]] = {}
        for w in known & self.prefix.keys():
            for i in self.prefix[w]:
                opened.setdefault(i, set()).add(w)
        out = {}
        for i, prefix in opened.items():
            if len(known & self.sets[i]) < self.need[i]:
                self.dropped["length"] += 1
                continue
            best = max((self._count(i, words, a, b) for a, b in self._stretches(words, prefix, self.width[i])), default=0)
            if best:
                out[i] = best / len(self.sets[i])
        return out

    @staticmethod
    def _stretches(words: list[str], prefix: set[str], width: int) -> list[list[int]]:
        """All that blocks around prefix words cover, overlapping ones as one."""
        out: list[list[int]] = []
        for at, w in enumerate(words):
            if w in prefix:
                a, b = max(0, at - width + 1), min(len(words), at + width)
                if out and a <= out[-1][1]:
                    out[-1][1] = b
                else:
                    out.append([a, b])
        return out

    def _count(self, i: int, words: list[str], a: int, b: int) -> int:
        """The most template words in any block of the stretch, 0 if fewer than needed."""
        own, need, size = self.sets[i], self.need[i], len(self.sets[i])
        rank = self.rank
        ranks = sorted({rank[w] for w in words[a:b] if w in rank})
        if len(ranks) < need:
            self.dropped["length"] += 1
            return 0
        here, hits = set(ranks), 0
        for p, w in enumerate(self.order[i][: size - need + 1]):
            if rank[w] in here:
                hits += 1
                if hits + min(size - p - 1, len(ranks) - bisect_right(ranks, rank[w])) < need:
                    self.dropped["position"] += 1
                    return 0
        places = [at for at in range(a, b) if words[at] in own]
        held: Counter = Counter()
        best = first = 0
        for at in places:
            held[words[at]] += 1
            while places[first] <= at - self.width[i]:
                w = words[places[first]]
                held[w] -= 1
                if not held[w]:
                    del held[w]
                first += 1
            best = max(best, len(held))
        return best if best >= need else 0


def template_frequencies(docs: DataFrame) -> dict[str, int]:
    """In how many documents of the whole corpus each template word occurs; as many rows as the templates have words."""
    wanted = {w for t in TEMPLATES for w in t.split()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                counts.update(wanted.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in found.collect()}


def phrase_places(words: list[str], known: set[str]) -> tuple[list[int], set[str]]:
    """Where the base phrases start, and their labels."""
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        if not known.issuperset(p):
            continue
        at = -1
        while True:
            try:
                at = words.index(p[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(p)] == p:
                places.append(at)
                labels.add(label)
    return places, labels


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: word count, places of the base phrases, base labels, all labels, and the best containment."""
    frequency = template_frequencies(docs)

    def make():
        index = TemplateIndex(frequency, threshold)

        def one(text):
            words = words_of(text)
            known = set(words)
            places, base = phrase_places(words, known)
            met = index.meet(words, known)
            labels = base | {index.labels[i] for i in met}
            best = 1.0 if base else max(met.values(), default=0.0)
            return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        return lambda texts: [pa.array(c, t) for c, t in zip(zip(*map(one, texts)), kinds)]

    return map_texts(docs, ["doc_id"], make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses found in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _literal(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_sql() -> str:
    """Brute force in SQL: every phrase at every word, every template in every window of words."""
    phrases = ", ".join(f"({_literal(p.split())}, '{label}')" for p, label in PHRASES.items())
    rows = [(i, *measures(t, THRESHOLD), label) for i, (t, label) in enumerate(TEMPLATES.items())]
    templates = ", ".join(f"({i}, {_literal(own)}, {need}, {width}, '{label}')" for i, own, need, width, label in rows)
    words = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
WITH phrases(p, label) AS (VALUES {phrases}), templates(i, t, need, width, label) AS (VALUES {templates}),
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT r, doc_id, {words} AS w FROM texts),
placed AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM worded),
places AS (
  SELECT r, label, i - 1 AS place FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM worded) x, phrases
  WHERE w[i] = p[1] AND w[i : i + len(p) - 1] = p),
based AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM places GROUP BY r),
tokens AS (SELECT i, need, width, len(t) AS size, label, unnest(t) AS word FROM templates),
occurs AS (
  SELECT r, i, need, width, size, label, word, pos FROM placed JOIN tokens USING (word)
  QUALIFY count(DISTINCT word) OVER (PARTITION BY r, i) >= need),
counted AS (
  SELECT r, i, need, size, label, count(DISTINCT word) OVER (PARTITION BY r, i ORDER BY pos RANGE BETWEEN CURRENT ROW AND (width - 1) FOLLOWING) AS n FROM occurs),
met AS (SELECT r, label, max(n) / size AS share FROM counted WHERE n >= need GROUP BY r, i, label, size),
labelled AS (SELECT r, label, 1.0::DOUBLE AS share, true AS base FROM places UNION ALL SELECT r, label, share, false FROM met),
summed AS (
  SELECT r, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM labelled GROUP BY r)
SELECT doc_id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM worded LEFT JOIN based USING (r) LEFT JOIN summed USING (r)
"""
