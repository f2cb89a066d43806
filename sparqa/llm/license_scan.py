"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

Native: DataFrame and ML functions only. Paragraphs are the lines of a text,
and its blocks of two or more lines between blank ones, in which a notice may
be wrapped. A multinomial logistic regression with an L1 part over word 1- to
3-grams is fitted on notices of each family, cut and varied by rule, and on a
bounded sample of the corpus' own paragraphs as the class ``none``. The
vocabulary holds the n-grams of the notices. Paragraphs that lack too many
words to be confirmed are left out before they are scored, which changes no
result. The probability of any licence below which a paragraph counts as
unknown is calibrated on a held-out part of the sample. The family is the most
probable one that the telling words agree with (version, affero, lesser,
sharealike and the like); it is confirmed if the paragraph holds enough of the
words of one of its templates, and enough of its pairs of neighbours in order.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparqa.functions.text import bind_column, let

from .common import saved

#: Paragraphs of the corpus in the class ``none``, of which every ``HELD_OUT``th only calibrates.
SAMPLE = 4000
HELD_OUT = 4
#: Share of held-out paragraphs that may pass as known, and the least probability in any case.
FALSE_KNOWN = 0.001
LEAST_PROBABILITY = 0.5
#: Share of a template's words that a paragraph must hold.
CONFIRM = 0.8
#: Share of its pairs of neighbouring words.
ORDER = 0.5
GRAMS = 3

def _gnu(name: str, short: str, version: str) -> list[str]:
    return [
        f"This work is licensed under the GNU {name}, version {version}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the"
        f" GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"GNU {name}, version {version}",
        f"Licensed under the {short} version {version} or later.",
        f"Licensed under the {short}v{version}.",
    ]


def _creative_commons(short: str, long: str) -> list[str]:
    return [
        f"Licensed under CC {short} 4.0.",
        f"This work is licensed under a Creative Commons {long} 4.0 International License.",
    ]


#: Short notices of each family (texts in common use).
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GPL.",
    ],
    "gpl-2.0": _gnu("General Public License", "GPL", "2"),
    "gpl-3.0": _gnu("General Public License", "GPL", "3"),
    "agpl-3.0": _gnu("Affero General Public License", "AGPL", "3"),
    "lgpl-2.1": _gnu("Lesser General Public License", "LGPL", "2.1"),
    "lgpl-3.0": _gnu("Lesser General Public License", "LGPL", "3"),
    "cc-by-4.0": _creative_commons("BY", "Attribution"),
    "cc-by-sa-4.0": _creative_commons("BY-SA", "Attribution-ShareAlike"),
    "cc-by-nc-4.0": _creative_commons("BY-NC", "Attribution-NonCommercial"),
    "cc-by-nd-4.0": _creative_commons("BY-ND", "Attribution-NoDerivatives"),
    "cc-by-nc-sa-4.0": _creative_commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "cc-by-nc-nd-4.0": _creative_commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "cc0-1.0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "bsd-2-clause": ["Released under the BSD 2-Clause License."],
    "bsd-3-clause": ["Released under the BSD 3-Clause License."],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "epl-2.0": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}


def _version(n: str) -> str:
    """Pattern of a version, in a text of ``tokens`` joined by spaces."""
    n = re.escape(n.removesuffix(".0"))
    return rf"\b(?:version|v|license) ?{n}(?:\.0)?(?![.\d])|\b[al]?gpl(?:[ -]?v| |-)?{n}(?:\.0)?(?![.\d])"


_AFFERO, _LESSER, _GNU = r"\baffero\b|\bagpl", r"\blesser\b|\blibrary general\b|\blgpl", r"\bgnu\b|\b[al]?gpl"
_NC, _SA, _ND = r"\bby[ -]nc\b|non-?commercial", r"\bby[ -](?:nc[ -])?sa\b|share-?alike", r"\bby[ -](?:nc[ -])?nd\b|no-?deriv"
_CC = r"\bcc\b|\bcreative commons\b"
_BSD = r"\bbsd\b|\bredistribution and use\b"
#: What speaks against any licence.
DENIED = (r"\b(?:not|never|isn t|aren t|no longer) (?:[a-z]+ )?"
          r"(?:licen[sc]ed|released|(?:available|distributed|covered) (?:[a-z]+ )?under|under)\b")


def _gnu_tells(version: str | None, kind: str | None) -> tuple[list[str], list[str]]:
    versions = ["1", "2", "2.1", "3"]
    return ([_GNU, *([_version(version)] if version else []), *([kind] if kind else [])],
            [*(_version(v) for v in versions if v != version), *(k for k in (_AFFERO, _LESSER) if k != kind)])


def _cc_tells(*parts: str) -> tuple[list[str], list[str]]:
    return [_CC, r"\b4\.0\b", *parts], [r"\b[123]\.[05]\b", *(p for p in (_NC, _SA, _ND) if p not in parts)]


#: Patterns that a paragraph of a family must all have, and patterns of which it may have none.
TELLS: dict[str, tuple[list[str], list[str]]] = {
    "apache-2.0": ([r"\bapache\b", r"\bv?2(?:\.0)?\b"], [r"\bapache (?:software )?license (?:version |v )?1\.[01]\b"]),
    "mit": ([r"\bmit\b|\bpermission is hereby granted\b"], []),
    "isc": ([r"\bisc\b|\bpermission to use\b"], []),
    "gpl": _gnu_tells(None, None),
    "gpl-2.0": _gnu_tells("2", None),
    "gpl-3.0": _gnu_tells("3", None),
    "agpl-3.0": _gnu_tells("3", _AFFERO),
    "lgpl-2.1": _gnu_tells("2.1", _LESSER),
    "lgpl-3.0": _gnu_tells("3", _LESSER),
    "cc-by-4.0": _cc_tells(),
    "cc-by-sa-4.0": _cc_tells(_SA),
    "cc-by-nc-4.0": _cc_tells(_NC),
    "cc-by-nd-4.0": _cc_tells(_ND),
    "cc-by-nc-sa-4.0": _cc_tells(_NC, _SA),
    "cc-by-nc-nd-4.0": _cc_tells(_NC, _ND),
    "cc0-1.0": ([r"\bcc0\b|\bwaived all copyright\b"], []),
    "bsd": ([_BSD], [r"\b[234]-clause\b"]),
    "bsd-2-clause": ([_BSD, r"\b2-clause\b"], [r"\b[34]-clause\b"]),
    "bsd-3-clause": ([_BSD, r"\b3-clause\b"], [r"\b[24]-clause\b"]),
    "mpl-2.0": ([r"\bmozilla\b|\bmpl\b", r"\b2\.0\b"], [r"\b1\.[01]\b"]),
    "epl-2.0": ([r"\beclipse\b|\bepl\b", r"\b2\.0\b"], [r"\b1\.0\b"]),
    "unlicense": ([r"\bunencumbered\b|\bunlicense\b"], []),
}
#: Sentences with words of notices that name no licence.
OTHERS = [
    "The driver showed a license and was released.", "The work is under review, see the version of 2.0 in the file.",
    "A public version of this program is free to any person.", "The general terms and conditions are met in this work.",
    "All rights reserved.", "This work was released in 2020.", "The license of the restaurant was granted under the new terms.",
    "You may use this file.", "Copyright of the authors, see the source for the terms.",
]
NONE = "none"
#: Words of templates that many paragraphs hold.
COMMON = frozenset("a and any as by file following for free in is it later may met not of or person program project provided public source terms that the this to under use version with without work you".split())


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits, dots and hyphens, without dots at their ends."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[.]+(?=[^a-z0-9]|$)", " "), "[^a-z0-9.\\-]+"), lambda w: w != "")


def grams(words: Column) -> Column:
    """The 1- to ``GRAMS``-grams of an array of words."""
    def of_size(w: Column, k: int) -> Column:
        first = F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))
        return F.transform(first, lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + j) for j in range(1, k))))

    return let(words, lambda w: F.concat(w, *(of_size(w, k) for k in range(2, GRAMS + 1))))


def _has_text(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) != ""


def paragraphs(docs: DataFrame, blocks: bool = False) -> DataFrame:
    """(doc_id, paragraph, n_lines, text): the lines of each text that aren't blank, counted from 0 over all lines.

    With ``blocks`` also the runs of two or more such lines, by the number of their first line.
    """
    def units(lines: Column) -> Column:
        some = lambda i: F.coalesce(_has_text(F.get(lines, i)), F.lit(False))
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        unit = lambda at, n, text: F.struct(at.alias("paragraph"), n.alias("n_lines"), text.alias("text"))
        single = F.transform(F.filter(every, some), lambda i: unit(i, F.lit(1), F.get(lines, i)))
        if not blocks:
            return single
        first = F.filter(every, lambda i: some(i) & some(i + 1) & ~some(i - 1))
        last = F.filter(every, lambda i: some(i) & some(i - 1) & ~some(i + 1))
        return F.concat(single, F.zip_with(first, last, lambda i, j: unit(i, j - i + 1, F.array_join(F.slice(lines, i + 1, j - i + 1), "\n"))))

    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.inline(let(lines, units)))


def _notices(spark: SparkSession) -> DataFrame:
    """Labelled training texts: each template whole, without its last word, in capitals, and inside other words."""
    rows = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            rows += [(t, family), (t.rsplit(" ", 1)[0] if t.count(" ") > 6 else t, family), (t.upper(), family),
                     (f"Copyright 2020 the authors. {t}", family), (f"{t} See the file for more.", family)]
    rows += [(t, NONE) for t in OTHERS for _ in range(3)]
    return spark.createDataFrame(rows, "text string, family string")


class LicenceModel:
    """The fitted vocabulary, regression and threshold."""

    def __init__(self, vocabulary: CountVectorizerModel, regression: LogisticRegressionModel, families: list[str], least: float) -> None:
        self.vocabulary, self.regression, self.families, self.least = vocabulary, regression, families, least

    def score(self, texts: DataFrame) -> DataFrame:
        """``texts`` with ``_words``, ``known`` (the probability of any licence) and ``by_family`` (those of the families)."""
        words = texts.withColumn("_words", tokens(F.col("text")))
        counted = self.vocabulary.transform(words.withColumn("_grams", grams(F.col("_words"))))
        out = self.regression.transform(counted).withColumn("_all", vector_to_array("_p"))  # class 0 is none
        return out.select(*texts.columns, "_words", (1 - F.get("_all", F.lit(0))).alias("known"),
                          F.slice("_all", 2, len(self.families) - 1).alias("by_family"))


def fit(docs: DataFrame) -> LicenceModel:
    """Fit on the notices and on at most ``SAMPLE`` paragraphs of ``docs`` (least hash first) without licence words."""
    spark = docs.sparkSession
    notices = saved(_notices(spark).withColumn("_grams", grams(tokens(F.col("text")))), "notices")
    positive = notices.where(F.col("family") != NONE)
    vocabulary = CountVectorizer(inputCol="_grams", outputCol="_counts", binary=True, minDF=1).fit(positive)
    h = F.xxhash64("doc_id", "paragraph")
    plain = paragraphs(docs).where(~F.lower("text").rlike(r"\b(?:licen[sc]e|copyright|gpl|creative commons|permission)"))
    sample = saved(plain.select("text", h.alias("h")).orderBy("h").limit(SAMPLE)
                   .withColumn("_grams", grams(tokens(F.col("text")))), "none")
    families = [NONE, *sorted(TEMPLATES)]
    label = F.array_position(F.array(*(F.lit(f) for f in families)), F.col("family")).cast("double") - 1
    train = notices.select("_grams", label.alias("label"), F.lit(4.0).alias("w")).unionByName(
        sample.where(F.pmod("h", F.lit(HELD_OUT)) != 0).select("_grams", F.lit(0.0).alias("label"), F.lit(1.0).alias("w")))
    regression = LogisticRegression(featuresCol="_counts", labelCol="label", weightCol="w", family="multinomial", maxIter=60, regParam=0.002,
                                    elasticNetParam=0.3, rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_class") \
        .fit(vocabulary.transform(train))
    held = regression.transform(vocabulary.transform(sample.where(F.pmod("h", F.lit(HELD_OUT)) == 0)))
    cut = held.select((1 - F.get(vector_to_array("_p"), F.lit(0))).alias("p")).agg(F.percentile_approx("p", 1 - FALSE_KNOWN)).first()[0] or 0.0
    return LicenceModel(vocabulary, regression, families, max(LEAST_PROBABILITY, min(cut, 0.95)))


def _template_tokens(text: str) -> list[str]:
    """The distinct ``tokens`` of a template, in Python."""
    plain = re.sub(r"[.]+(?=[^a-z0-9]|$)", " ", text.lower())
    return list(dict.fromkeys(w for w in re.split(r"[^a-z0-9.\-]+", plain) if w))


def _may_lack(words: int) -> int:
    """The most of a template's words that a confirmed paragraph may lack."""
    return words - next(k for k in range(words + 1) if k / words >= CONFIRM)


def _needed_words() -> list[str]:
    """Words of which every paragraph that can be confirmed has one.

    Of each template one word more than a paragraph may lack: of those that
    aren't common the ones that most templates have, the longest first.
    """
    own = [_template_tokens(t) for texts in TEMPLATES.values() for t in texts]
    held = Counter(w for words in own for w in words)
    out = set()
    for words in own:
        out.update(sorted(words, key=lambda w: (w in COMMON, -held[w], -len(w), w))[: _may_lack(len(words)) + 1])
    return sorted(out)


def _may_hold(text: Column) -> Column:
    """Whether a lower-case text has one of the needed words anywhere, also inside longer words."""
    words = _needed_words()
    short = [w for w in words if not any(x in w for x in words if x != w)]
    return reduce(or_, (F.contains(text, F.lit(w)) for w in short))


def _needed_re() -> str:
    """Pattern of the needed words in a lower-case text. What ends a token is no letter or digit, but may be ``_``."""
    return "(?<![a-z0-9])(?:" + "|".join(map(re.escape, _needed_words())) + ")(?![a-z0-9])"


def _families(names: list[str]) -> Column:
    """The families as an array of (name, must, never, templates), each template with its words and pairs."""
    text = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")

    def template(t: str) -> Column:
        own = _template_tokens(t)
        every = [w for w in re.split(r"[^a-z0-9.\-]+", re.sub(r"[.]+(?=[^a-z0-9]|$)", " ", t.lower())) if w]
        pairs = list(dict.fromkeys(map(" ".join, zip(every, every[1:]))))
        return F.struct(text(own).alias("words"), text(pairs).alias("pairs"))

    return F.array(*(F.struct(F.lit(n).alias("name"), text(TELLS[n][0]).alias("must"), text(TELLS[n][1]).alias("never"),
                              F.array(*map(template, TEMPLATES[n])).alias("templates")) for n in names))


def _share(words: Column, templates: Column) -> Column:
    """Largest share of a template's distinct words in ``words``, among the templates of which enough pairs are there in order."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    part = lambda has, of: F.size(F.array_intersect(has, of)) / F.size(of)
    return let(pairs, lambda p: F.array_max(F.transform(
        templates, lambda t: F.when(part(p, t["pairs"]) >= ORDER, part(words, t["words"])).otherwise(0.0))))


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """doc_id, paragraph, n_lines, family, probability, template_share of every paragraph that names a licence, confirmed.

    ``paragraph`` is the number of its first line. A block of lines is
    reported only if none of its lines is confirmed for its family. Of equally
    probable families the last name is taken. A null or empty text has no
    paragraphs; texts of any length are read whole. Repeated rows are reported
    each. An empty table gives no rows (and a model of the notices alone).
    Columns other than doc_id and text are not looked at.
    """
    fitted = model or fit(docs.select("doc_id", "text"))
    held = docs.select("doc_id", "text").where(let(F.lower("text"), _may_hold))
    may = paragraphs(held, blocks=True).where(let(F.lower("text"), lambda t: _may_hold(t) & t.rlike(_needed_re())))
    known = fitted.score(may).where(F.col("known") >= fitted.least)

    def agreeing(row_text: Column) -> Column:
        scored = F.zip_with(_families(fitted.families[1:]), F.col("by_family"), lambda f, p: F.struct(p.alias("p"), f.alias("f")))
        return F.filter(scored, lambda x: ~row_text.rlike(DENIED) & F.forall(x["f"]["must"], lambda m: F.regexp_like(row_text, m))
                        & ~F.exists(x["f"]["never"], lambda m: F.regexp_like(row_text, m)))

    most = lambda found: F.reduce(found, F.get(found, F.lit(0)), lambda a, b: F.when(b["p"] >= a["p"], b).otherwise(a))
    best = let(let(F.array_join("_words", " "), agreeing), most)
    named = bind_column(known, best, "best").where(F.col("best").isNotNull()) \
        .withColumn("template_share", _share(F.col("_words"), F.col("best.f.templates"))).where(F.col("template_share") >= CONFIRM)
    own_line = F.exists(F.split("text", "\n"), lambda t: let(tokens(t), lambda w: _share(w, F.col("best.f.templates"))) >= CONFIRM)
    return named.where((F.col("n_lines") == 1) | ~own_line).select(
        "doc_id", "paragraph", "n_lines", F.col("best.f.name").alias("family"), F.round("known", 6).alias("probability"),
        F.round("template_share", 6).alias("template_share"))
