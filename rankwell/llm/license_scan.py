"""Licence scans by a trained paragraph classifier (native plans only).

A multinomial logistic regression over the presence of word n-grams (one to three
words, made sparse by an L1 penalty) tells licence families and "no licence" apart. It
is trained on the notices below and on variants made from them by rule. Its
temperature and the least confidence for naming a family are set on variants that were
held back. Notices of licences outside the families train a class of their own; what falls
into it, or looks like a licence but is not surely of one family, is "unknown". A named family is confirmed by comparing the paragraph with the family's
notices.

Every n-gram that counts holds a word that is not in STOP, so a text without any such
word of the model has no feature at all, and only the others are taken apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

# Customary notices of licence families, the words of other English
# sentences that resemble them, and stop words.
NOTICES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "released under the agpl 3 0 license", "this program is free software under the terms of the gnu affero general public license"],
    "apache": ["licensed under the apache license version 2 0", "released under the apache license version 2 0", "you may not use this file except in compliance with the apache license", "this work is licensed under the apache 2 0 license", "available under the apache 2 0 license"],
    "bsd": ["released under the bsd 3 clause license", "licensed under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "distributed under the bsd 2 clause license"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "available under the creative commons attribution license cc by"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "released under cc by nc", "available under the creative commons attribution noncommercial license cc by nc"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "text is available under the creative commons attribution sharealike license cc by sa"],
    "cc0": ["released under cc0 1 0", "dedicated to the public domain under cc0", "this is free and unencumbered software released into the public domain"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 2", "released under the gpl 3 0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "released under the lgpl 2 1", "under the terms of the gnu lesser general public license"],
    "mit": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "distributed under the terms of the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["licensed under the mozilla public license version 2 0", "this source code form is subject to the terms of the mozilla public license", "released under the mpl 2 0"],
    "reserved": ["all rights reserved", "copyright all rights reserved no part of this publication may be reproduced without permission"],
}
UNLISTED = [
    "licensed under the eclipse public license version 2 0", "licensed under the eupl version 1 2", "licensed under the european union public licence", "released under the zlib license", "distributed under the boost software license version 1 0",
    "available under the artistic license 2 0", "licensed under the microsoft public license", "released under the isc license", "licensed under the common development and distribution license", "this work is licensed under the open font license version 1 1",
    "released under the academic free license", "licensed under the business source license", "spdx license identifier epl 2 0", "spdx license identifier eupl 1 2", "spdx license identifier zlib", "spdx license identifier bsl 1 0", "available under the open database license", "this file is licensed under the terms of a custom public license",
]
OTHERS = [
    "the driver had a license to work in the city", "she was released under heavy rain and went to the public garden", "the version of the story that was published is not the one they wrote",
    "permission to leave was granted by the general", "the apache people lived in the south west", "students of mit built the machine in the spring", "he bought two copies of the book and a file for the notes",
    "terms of the agreement are under review", "the source of the river is in the mountains", "software is made by people who like to work together", "a general election was held in may",
    "the public is invited to the creative workshop", "common sense is not so common", "the domain of the function is the real line", "all seats are reserved for members", "the foundation of the house is made of stone",
    "version 2 0 of the report was sent to the office", "in compliance with the rules they stopped work at noon", "attribution of the painting is not certain", "free entry for children under 4",
    "he has a license to drive", "the license office is closed on sunday", "she got her license in may and drove to the city", "the film was shown under license in two cities", "a public license for the market costs 20", "the fishing license is valid for a year",
]
FILLER = ["it", "was", "in", "the", "house", "and", "they", "said", "that", "many", "people", "would", "come", "to", "see", "new", "things", "for", "a", "day"]
STOP = frozenset("a all and any are as at be by can for from had has he in into is it made may no not of on one or part she so that the they this to under use was we with who you only later 0 1 2 3 4".split())
#: SPDX names of the families, as words.
SPDX = {
    "agpl": ["agpl 3 0 only", "agpl 3 0 or later"], "apache": ["apache 2 0"], "bsd": ["bsd 2 clause", "bsd 3 clause"], "cc-by": ["cc by 4 0", "cc by 3 0"], "cc-by-nc": ["cc by nc 4 0"], "cc-by-sa": ["cc by sa 4 0", "cc by sa 3 0"], "cc0": ["cc0 1 0", "unlicense"],
    "gpl": ["gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later"], "lgpl": ["lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl 3 0 or later"], "mit": ["mit"], "mpl": ["mpl 2 0"],
}
NOTICES |= {family: [*NOTICES[family], *(f"spdx license identifier {name}" for name in names)] for family, names in SPDX.items()}
NONE = "none"
UNKNOWN = "unknown"
#: Least share of a notice's three-word runs that must be in the paragraph.
CONFIRM = 0.6
#: Words of the longest notice: one that is wrapped lies within as many on either side of its first line break.
SPAN = max(len(t.split()) for texts in NOTICES.values() for t in texts)
_PATTERN = "[^a-z0-9]+"


def _variants(words: list[str], seed: int) -> list[list[str]]:
    """The words alone and within filler, whole and with one word gone."""
    n, out = len(words), [words]
    for k in range(4):
        at = (seed * 7 + k * 5) % len(FILLER)
        before, after = (FILLER * 2)[at : at + 3 * k], (FILLER * 2)[at + 2 : at + 2 + 4 * (3 - k)]
        own = words if k % 2 or n < 6 else words[: (seed + k) % n] + words[(seed + k) % n + 1 :]
        out.append(before + own + after)
    return out


def _training_rows() -> list[tuple[str, str, bool]]:
    """label, text, held back."""
    labelled = [(family, t) for family, texts in NOTICES.items() for t in texts] + [(UNKNOWN, t) for t in UNLISTED] + [(NONE, t) for t in OTHERS]
    out = []
    for seed, (label, text) in enumerate(labelled):
        out += [(label, " ".join(v), k == 3) for k, v in enumerate(_variants(text.split(), seed))]
    out += [(NONE, " ".join((FILLER * 2)[k : k + 9]), k % 4 == 3) for k in range(len(FILLER))]
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _PATTERN), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    last = F.size(words) - F.lit(n - 1)
    found = F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice(words, k, n), " "))
    return F.when(last >= 1, found).otherwise(F.array().cast("array<string>"))


def _grams(words: Column) -> Column:
    """Distinct runs of one to three words that are not stop words alone."""
    stop = F.array(*map(F.lit, sorted(STOP)))
    every = F.concat(*(_runs(words, n) for n in (1, 2, 3)))
    return F.filter(F.array_distinct(every), lambda g: ~F.forall(F.split(g, " "), lambda w: F.array_contains(stop, w)))


def _known(words: Column, model: LicenceModel) -> tuple[Column, Column]:
    """The distinct n-grams that the model weighs, and the distinct three-word runs of notices; no others are kept."""
    runs = sorted({r for _, s in _shapes() for r in s})
    grams = F.filter(_grams(words), lambda g: g.isin(sorted(model.weights)))
    return grams.alias("grams"), F.filter(F.array_distinct(_runs(words, 3)), lambda r: r.isin(runs)).alias("runs")


@dataclass
class LicenceModel:
    """Families (NONE included), their intercepts, weights by n-gram, temperature and least confidence."""

    families: list[str]
    intercepts: list[float]
    weights: dict[str, list[float]]
    temperature: float
    least: float

    def probabilities(self, margins: list[float]) -> list[float]:
        top = max(margins)
        e = [exp((m - top) / self.temperature) for m in margins]
        return [x / sum(e) for x in e]


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def train(spark: SparkSession) -> LicenceModel:
    """Fit on the notices' variants; calibrate on those held back."""
    families = [NONE, UNKNOWN, *sorted(NOTICES)]
    rows = [(float(families.index(label)), text, held) for label, text, held in _training_rows()]
    data = _frame(spark, rows, "label double, text string, held boolean").withColumn("words", _words(F.col("text")))
    data = data.select("label", "held", _grams(F.col("words")).alias("grams")).coalesce(1).cache()
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(data.where("NOT held"))
    model = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=0.002, maxIter=80).fit(counter.transform(data.where("NOT held")))
    matrix = model.coefficientMatrix.toArray()
    weights = {g: [float(x) for x in matrix[:, k]] for k, g in enumerate(counter.vocabulary) if matrix[:, k].any()}
    fitted = LicenceModel(families, [float(x) for x in model.interceptVector], weights, 1.0, 0.0)
    held = [(int(r["label"]), _margins(fitted, r["grams"])) for r in data.where("held").collect()]
    data.unpersist()
    grid = [0.25 * 1.25**k for k in range(16)]
    losses = []
    for t in grid:
        fitted.temperature = t
        losses.append((-sum(log(max(1e-12, fitted.probabilities(m)[y])) for y, m in held), t))
    fitted.temperature = min(losses)[1]
    # what else is named must be surer than any family that was wrongly named
    wrong = [max(p) for y, m in held if (p := fitted.probabilities(m))[y] < max(p) and families[p.index(max(p))] in NOTICES]
    fitted.least = max([0.5, *wrong])
    return fitted


def _margins(model: LicenceModel, grams: list[str]) -> list[float]:
    rows = [model.weights[g] for g in grams if g in model.weights]
    return [b + sum(r[k] for r in rows) for k, b in enumerate(model.intercepts)]


def _shapes() -> list[tuple[str, list[str]]]:
    """Family and distinct three-word runs of each notice."""
    return [(f, sorted({" ".join(w[k : k + 3]) for k in range(len(w) - 2)})) for f, texts in sorted(NOTICES.items()) for w in map(str.split, texts)]


def _told(pieces: DataFrame, model: LicenceModel) -> DataFrame:
    """Rows row, line, family, p, held, sure for the pieces (row, line, grams, runs) that look like a licence.

    ``held``: enough of a notice of the family is there; ``sure``: and the family is surely told.
    """
    spark = pieces.sparkSession
    names = [f"w{k}" for k in range(len(model.families))]
    table = _frame(spark, [(g, *w) for g, w in sorted(model.weights.items())], "gram string, " + ", ".join(f"{n} double" for n in names))
    sums = pieces.select("row", "line", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram").groupBy("row", "line").agg(*(F.sum(n).alias(n) for n in names))
    scaled = F.array(*((F.col(n) + F.lit(b)) / F.lit(model.temperature) for n, b in zip(names, model.intercepts, strict=True)))
    told = sums.select("row", "line", scaled.alias("m")).withColumn("top", F.array_max("m"))
    total = F.aggregate("m", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    told = told.select("row", "line", F.get(F.array(*map(F.lit, model.families)), F.array_position("m", F.col("top")).cast("int") - 1).alias("family"), (F.lit(1.0) / total).alias("p"))
    told = told.where((F.col("family") != NONE) & ((F.col("family") != UNKNOWN) | (F.col("p") >= 0.5))).join(pieces.select("row", "line", "runs"), ["row", "line"])

    shapes = _frame(spark, _shapes(), "family string, shape array<string>").groupBy("family").agg(F.collect_list("shape").alias("shapes"))
    shares = F.transform(F.col("shapes"), lambda s: F.size(F.array_intersect(s, F.col("runs"))) / F.size(s))
    told = told.join(F.broadcast(shapes), "family", "left").withColumn("held", F.coalesce(F.array_max(shares) >= CONFIRM, F.lit(False)))
    return told.select("row", "line", "family", "p", "held", (F.col("held") & (F.col("p") >= model.least)).alias("sure"))


def _wrapped(rows: DataFrame, held: DataFrame, model: LicenceModel) -> DataFrame:
    """Rows row, line, last, grams, runs: words around the line breaks where enough of some notice may be, without the lines of ``held``.

    ``line`` is the line before the break, ``last`` the last line that has words in the piece.
    """
    shapes = [s for _, s in _shapes()]
    known = sorted({r for s in shapes for r in s})

    def joined(tail: Column, follow: Column) -> Column:
        return F.concat(tail, F.slice(F.flatten(follow), 1, SPAN))

    def around(lines: Column, k: Column) -> Column:
        tail = F.reverse(F.slice(F.reverse(F.element_at(lines, k)), 1, SPAN))
        return F.struct((k - 1).alias("line"), tail.alias("tail"), F.transform(F.slice(lines, k + 1, SPAN), lambda w: F.slice(w, 1, SPAN)).alias("follow"))

    def paragraph(b: Column) -> Column:
        blank = F.array_position(F.transform(b["follow"], F.size), 0).cast("int")
        return F.struct(b["line"].alias("line"), b["tail"].alias("tail"), F.when(blank > 0, F.slice(b["follow"], 1, blank - 1)).otherwise(b["follow"]).alias("follow"))

    def with_words(b: Column) -> Column:
        return F.struct(b["line"].alias("line"), b["tail"].alias("tail"), b["follow"].alias("follow"), joined(b["tail"], b["follow"]).alias("words"))

    def with_runs(b: Column) -> Column:
        return F.struct(b["line"].alias("line"), b["tail"].alias("tail"), b["follow"].alias("follow"), F.filter(_runs(b["words"], 3), lambda r: r.isin(known)).alias("runs"))

    def breaks(lines: Column) -> Column:
        # each step is an argument of the next, so nothing is evaluated again for each word
        found = F.transform(F.sequence(F.lit(1), F.size(lines) - 1), lambda k: around(lines, k))
        found = F.transform(F.filter(found, lambda b: F.size(b["tail"]) > 0), paragraph)
        found = F.transform(F.transform(F.filter(found, lambda b: F.size(b["follow"]) > 0), with_words), with_runs)
        return F.filter(found, lambda b: F.size(b["runs"]) > 0)

    split = F.split("text", "\n")
    several = rows.where(F.col("text").isNotNull() & F.col("text").contains("\n"))
    found = several.select("row", F.explode(F.flatten(F.transform(F.array(F.transform(split, _words)), breaks))).alias("b"))
    enough = F.exists(F.array(*(F.array(*map(F.lit, s)) for s in shapes)), lambda s: F.size(F.array_intersect(s, F.col("b.runs"))) >= CONFIRM * F.size(s))
    found = stored(found.where(enough).select("row", "b.line", "b.tail", "b.follow"), "breaks")

    own = held.groupBy("row").agg(F.collect_set("line").alias("own"))
    found = found.join(own, "row", "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>"))).where(~F.array_contains("own", F.col("line")))
    cut = F.array_position(F.transform("follow", lambda w, n: F.array_contains("own", F.col("line") + 1 + n)), True).cast("int")
    found = found.withColumn("follow", F.when(cut > 0, F.slice("follow", 1, cut - 1)).otherwise(F.col("follow"))).where(F.size("follow") > 0)
    reached = F.size(F.filter("follow", lambda w, n: F.size(F.flatten(F.slice("follow", 1, n))) < SPAN))
    found = found.select("row", "line", (F.col("line") + reached).alias("last"), F.explode(F.array(joined(F.col("tail"), F.col("follow")))).alias("words"))
    return stored(found.select("row", "line", "last", *_known(F.col("words"), model)), "wide")


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """Rows id, licence, families, n_notices, confidence: one per input row.

    Paragraphs are lines, and for notices that are wrapped the words around line breaks
    (no further than the next line without a word, or that holds a notice of its own).
    A wrapped notice counts once, and the lines it spans are not "unknown" besides;
    wrapped notices of one family on lines in a row count as one. ``families`` lists the distinct families found, in order and
    joined by commas; ``licence`` is the one with the most confident paragraph (ties: the
    first name), "unknown" if only unnamed licence-like paragraphs were found, or null.
    ``confidence`` is that paragraph's calibrated probability (null without one). Null and
    empty texts have none. Ids may be null or repeat; other columns are ignored.
    """
    spark = docs.sparkSession
    model = model or train(spark)
    content = sorted({w for g in model.weights for w in g.split() if w not in STOP})
    hit = F.arrays_overlap(F.split(F.lower(F.col(text_col)), _PATTERN), F.array(*map(F.lit, content)))
    rows = docs.select(F.col(id_col).alias("id"), F.when(hit, F.col(text_col)).alias("text"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")

    lines = rows.where("text IS NOT NULL").select("row", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    lines = lines.withColumn("words", _words(F.col("words"))).where(F.arrays_overlap("words", F.array(*map(F.lit, content))))
    lines = stored(lines.select("row", "line", *_known(F.col("words"), model)), "lines")
    told = stored(_told(lines, model), "told")

    wide = _wrapped(rows, told.where("held"), model)
    named = _told(wide, model).where("sure").join(wide.select("row", "line", "last"), ["row", "line"])
    by_line = Window.partitionBy("row", "family").orderBy("line")
    named = named.withColumn("n", F.sum(F.coalesce((F.lag("line").over(by_line) < F.col("line") - 1).cast("int"), F.lit(0))).over(by_line))
    named = stored(named.groupBy("row", "family", "n").agg(F.max("p").alias("p"), F.min("line").alias("begin"), F.max("last").alias("last")), "wrapped")
    within = (F.col("told.row") == F.col("named.row")) & F.col("line").between(F.col("begin"), F.col("last")) & ~F.col("sure")
    told = told.alias("told").join(named.alias("named"), within, "left_anti").select("row", "p", F.when(F.col("sure"), F.col("family")).otherwise(UNKNOWN).alias("family"))
    told = told.unionByName(named.select("row", "p", "family"))

    first = F.min(F.struct((F.col("family") == UNKNOWN).alias("unnamed"), (-F.col("p")).alias("p"), "family"))
    found = told.groupBy("row").agg(F.count(F.lit(1)).alias("n_notices"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), first.alias("best"))
    joined = rows.select("row", "id").join(found, "row", "left")
    return joined.select("id", F.col("best.family").alias("licence"), "families", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), (-F.col("best.p")).alias("confidence"))
