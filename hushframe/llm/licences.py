"""Licence scans by a trained paragraph classifier, with DataFrame functions and Spark's own learners.

Lines with licence vocabulary are candidates, and so are runs of such lines, put together: a notice
may be wrapped. Features are the word n-grams around that vocabulary. Sparse multinomial logistic
regression, trained on the notices, names and ordinary sentences below with words left out, names
the family; its probabilities are tempered on variants kept apart, and those under a
threshold are unknown. A family counts as confirmed if the paragraph shares enough word pairs with
one of its notices.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import settle

#: Short public notices of each family, as they stand in files and pages.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "This project is released under the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL version 3.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0.",
    ],
    "reserved": [
        "Copyright 2021 Example Corporation. All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without prior written permission.",
    ],
}
#: A family named in passing, without the words of a notice. For training only: nothing is confirmed by them.
NAMED = {
    "MIT": ["MIT", "License: MIT", "SPDX: MIT", "MIT/X11", "Dual MIT / Apache 2.0", "Distributed under MIT terms", "unter der MIT-Lizenz", "sous licence MIT", "bajo licencia MIT"],
    "Apache-2.0": ["Apache 2.0", "Apache-2.0", "SPDX: Apache-2.0", "Distributed under Apache 2.0", "Released under Apache terms", "the Apache 2.0 terms", "unter der Apache-Lizenz", "sous licence Apache", "bajo licencia Apache"],
    "GPL": ["GPL", "GPLv3", "GPL-3.0", "GPL-2.0-or-later", "SPDX: GPL-3.0-only", "Distributed under GPL v3", "Released under GNU GPL version 2", "Distributed under the terms of the GNU", "unter der GPL", "sous licence GPL", "bajo licencia GPL"],
    "LGPL": ["LGPL", "LGPL-2.1", "SPDX: LGPL-2.1-only", "Distributed under LGPL v2.1", "Released under LGPL terms", "unter der LGPL", "sous licence LGPL"],
    "AGPL": ["AGPL", "AGPL-3.0", "SPDX: AGPL-3.0-only", "Distributed under AGPL v3", "Released under GNU Affero terms", "unter der AGPL"],
    "BSD": ["BSD", "BSD 3-Clause", "BSD-2-Clause", "SPDX: BSD-3-Clause", "Distributed under BSD terms", "Released under 3-clause BSD", "unter der BSD-Lizenz", "sous licence BSD"],
    "MPL": ["MPL", "MPL-2.0", "SPDX: MPL-2.0", "Distributed under MPL 2.0", "Released under Mozilla terms", "sous licence Mozilla"],
    "ISC": ["License: ISC", "SPDX: ISC", "Distributed under ISC terms", "Released under ISC", "ISC licence"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "CC BY", "SPDX: CC-BY-4.0", "Text: CC BY", "Distributed under CC BY 3.0", "Available as CC BY 4.0", "sous licence CC BY"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA", "Distributed under CC BY-SA 3.0", "sous licence CC BY-SA"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC", "Distributed under CC BY-NC 3.0", "sous licence CC BY-NC"],
    "public-domain": ["CC0", "CC0 1.0", "CC0-1.0", "Released under CC0", "Dedicated to the public domain", "The Unlicense"],
    "reserved": ["All rights reserved", "Alle Rechte vorbehalten. Copyright", "Tous droits reserves. Copyright"],
}
#: Ordinary sentences with licence vocabulary.
ORDINARY = [
    "He lost his driving license last year.", "A fishing licence costs ten dollars a year.", "She asked for permission to leave early.",
    "The warranty on the washing machine expired.", "The software crashed twice this morning.", "A copyright dispute went to court.",
    "They distributed the leaflets in town.", "The Apache tribe lived in the southwest.", "Creative people meet in commons and libraries.",
    "She studied at MIT and moved to Boston.", "A professor from MIT gave the talk.", "The public was not amused by the version shown.", "Source of the river and its redistribution of land.",
    "The licensed pilot landed safely.", "General terms and conditions of the sale apply.", "Everybody has rights and duties.", "The public eye; a domain of his own.",
    "Die Lizenz des Piloten wurde verlangert.", "Sa licence de football est valable un an.", "La licencia de pesca cuesta diez euros.", "The foundation of the house is reserved stone.",
    "Seats are reserved for members.", "An attribution of the painting to Rubens.", "We use new software at work.", "Permission was granted to build a house.", "He was granted a license to fish.",
]
#: Licence vocabulary, as ``words_of`` cuts it. A paragraph is a candidate if it has one of these; features are n-grams with one of them.
VOCABULARY = (
    "license", "licensed", "licenses", "licence", "licences", "licensing", "licensee", "lizenz", "lizenziert", "licencia", "spdx", "identifier", "copyright", "copyrighted",
    "permission", "permitted", "redistribute", "redistribution", "redistributions", "redistributed", "software", "warranties", "warranty", "gnu", "gpl", "lgpl", "agpl", "affero",
    "apache", "mitname", "bsd", "mozilla", "mpl", "isc", "creative", "commons", "attribution", "cc", "cc0", "by-nc", "by-sa", "noncommercial", "sharealike", "unencumbered",
    "unlicense", "reserved", "vorbehalten", "reserves", "domain", "foundation",
)
NONE = "none"
NGRAMS, GRAMS, ROUNDS = (1, 2, 3), 1 << 13, 100  # rounds at most; the learner stops where its loss does
VARIANTS, DROP = 24, 8  # variants of each notice; one word in DROP is left out
UNKNOWN_BELOW, CONFIRM_FROM = 0.5, 0.4


def spelt(text: Column) -> Column:
    """One spelling of names: the institute's letters only as capitals among small letters (else they are a German word), versions apart from what they follow."""
    shouted = F.regexp_count(text, F.lit(r"\p{Lu}{3,}")) >= SHOUTED
    named = F.when(shouted, text).otherwise(F.regexp_replace(text, r"(?<![A-Za-z])MIT(?![A-Za-z])", "mitname"))
    bare = F.translate(F.lower(named), "äöüßéèêáíóúñç", "aouseeeaiounc")
    apart = F.regexp_replace(bare, r"(?<![a-z])(cc|[al]?gpl|bsd|mpl|apache|mitname)[\-/]?(?=v?[0-9]|by|x11|lizenz|only)", "$1 ")
    return F.regexp_replace(apart, r"(?<![a-z])by (sa|nc)(?![a-z])", "by-$1")


def words_of(text: Column) -> Column:
    return F.filter(F.split(spelt(text), r"[^a-z0-9\-]+"), lambda w: F.length(w) > 0)


#: Words in capitals from which on a paragraph is in capitals as a whole.
SHOUTED = 6
#: Any candidate holds one of these, small or in capitals; and of names that are parts of ordinary words, one of these as it is.
HINTS = (
    "licen", "lizenz", "spdx", "copyright", "permission", "permitted", "redistribut", "software", "warrant", "gnu", "gpl", "affero", "apache", "bsd", "mozilla", "creative commons",
    "attribution", "cc by", "cc-by", "cc0", "by-nc", "by-sa", "noncommercial", "sharealike", "unencumbered", "rights reserved", "reserves", "vorbehalten", "public domain",
)
CAPITALS = ("MIT", "MPL", "ISC")


def may_have(text: Column) -> Column:
    """Whether a text holds a hint: plain tests of bytes, as a pattern with so many branches is far slower. The lower-cased text is made once."""
    small = F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [F.contains(t, F.lit(h)) for h in HINTS]))
    return reduce(or_, [F.contains(text, F.lit(h)) for h in CAPITALS]) | small


def candidate(text: Column) -> Column:
    """Whether a text has a hint and a word of the vocabulary."""
    return may_have(text) & F.arrays_overlap(words_of(text), F.array(*map(F.lit, VOCABULARY)))


def ngrams(words: Column, n: int) -> Column:
    """All slices of n words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(words, i, n))


def features(words: str) -> Column:
    """N-grams of the word array column that hold licence vocabulary."""
    known = F.array(*map(F.lit, VOCABULARY))
    held = [F.filter(ngrams(F.col(words), n), lambda g: F.arrays_overlap(g, known)) for n in NGRAMS]
    return F.concat(*[F.transform(grams, lambda g: F.array_join(g, " ")) for grams in held])


def with_grams(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("words", words_of(F.col(text))).withColumn("grams", features("words"))


def paragraphs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Candidates ``(doc, row, at, run, paragraph)``: lines with licence vocabulary, and runs of two such lines or more as one text (``run`` true).

    ``row`` tells rows apart that repeat an id; runs do not go over lines without vocabulary.
    """
    rows = docs.where(may_have(F.col(text))).select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("row"), F.split(text, "\n", -1).alias("lines"))
    lines = rows.select("doc", "row", F.posexplode("lines").alias("at", "paragraph")).where(candidate(F.col("paragraph")))
    lines = settle(lines.distinct())
    island = F.col("at") - F.row_number().over(Window.partitionBy("doc", "row").orderBy("at"))
    runs = lines.withColumn("island", island).groupBy("doc", "row", "island").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("at", "paragraph"))).alias("ls"))
    whole = F.array_join(F.transform("ls", lambda x: x["paragraph"]), " ")
    runs = runs.where("n > 1").select("doc", "row", "at", F.lit(True).alias("run"), whole.alias("paragraph"), (F.col("at") + F.col("n")).cast("int").alias("upto"))
    return lines.select("doc", "row", "at", F.lit(False).alias("run"), "paragraph", (F.col("at") + 1).alias("upto")).unionByName(runs)


def training_rows(spark: SparkSession) -> DataFrame:
    """``(label, paragraph, tuning)``: notices, names and ordinary sentences, with words left out.

    All have licence vocabulary, as all paragraphs have that the model is asked about; lines
    without any would only teach it to say no.
    """
    families = [NONE, *NOTICES]
    fixed = [(float(families.index(f)), n) for named in (NOTICES, NAMED) for f, ns in named.items() for n in ns] + [(0.0, n) for n in ORDINARY]
    rows = spark.createDataFrame(fixed, "label double, notice string").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    keep = lambda w, i: (F.col("variant") % 4 == 0) | (F.pmod(F.xxhash64(w, i, F.col("variant")), F.lit(DROP)) != 0)
    varied = rows.select("label", F.array_join(F.filter(F.split("notice", " "), keep), " ").alias("paragraph"), (F.col("variant") % 4 == 3).alias("tuning"))
    return varied


class LicenceModel:
    """Weights, temperature and the families in order of their labels."""

    def __init__(self, spark: SparkSession):
        self.families = [NONE, *NOTICES]
        # A bounded sample: two tasks are enough for each of the learner's rounds.
        rows = settle(with_grams(training_rows(spark), "paragraph").select("label", "grams", "tuning").coalesce(2))
        # Only n-grams met in training count: hashed, the many n-grams of a long ordinary line fall on those of licences.
        self.grams = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=GRAMS, minDF=2, binary=True).fit(rows)
        rows = settle(self.grams.transform(rows).drop("grams"))
        learner = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.2, maxIter=ROUNDS, labelCol="label")
        self.model: LogisticRegressionModel = learner.fit(rows.where("not tuning"))
        self.temperature = self._temper(rows.where("tuning").select("label", "features"))

    def logits(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``logits``, written once: what follows reads each several times."""
        rows = rows if "features" in rows.columns else self.grams.transform(with_grams(rows, "paragraph")).drop("grams", "words")
        return settle(self.model.transform(rows).withColumn("logits", vector_to_array("rawPrediction")).drop("features", "rawPrediction", "probability", "prediction"))

    def _temper(self, rows: DataFrame) -> float:
        """The temperature of least log loss on the variants kept apart."""
        grid = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8]
        rows = self.logits(rows)
        losses = [F.avg(-F.log(F.greatest(F.get(softmax(F.col("logits"), t), F.col("label").cast("int")), F.lit(1e-9)))) for t in grid]
        found = rows.agg(*losses).first()
        return min(zip(found, grid, strict=True))[1]


def softmax(logits: Column, temperature: float) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda z: F.exp((z - top) / temperature))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def licence_findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per finding: ``doc, row, at, paragraph, family, probability, confirmed``.

    ``family`` is ``unknown`` where the calibrated probability of the best family is below
    ``UNKNOWN_BELOW``; paragraphs judged ordinary are left out. A run of lines is a finding of
    its own only if it names a family for sure that none of its lines names for sure.
    """
    model = LicenceModel(docs.sparkSession)
    names = F.array(*map(F.lit, model.families))
    found = model.logits(paragraphs(docs, doc_id, text))
    found = found.withColumn("p", softmax(F.col("logits"), model.temperature)).withColumn("probability", F.array_max("p"))
    best = F.get(names, (F.array_position("p", F.col("probability")) - 1).cast("int"))
    found = found.withColumn("best", best).where(F.col("best") != NONE).withColumn("words", words_of(F.col("paragraph")))
    starts = F.when(F.size("words") > 1, F.sequence(F.lit(1), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("words", i, 2), " ")))
    found = settle(found.select("doc", "row", "at", "upto", "run", "paragraph", "best", "probability", pairs.alias("pairs")))
    shares = []
    for family, notices in NOTICES.items():
        for notice in notices:
            words = "".join(c if c.isascii() and (c.isalnum() or c == "-") else " " for c in notice.lower()).split()
            own = sorted({" ".join(x) for x in zip(words, words[1:], strict=False)})
            share = F.size(F.array_intersect("pairs", F.array(*map(F.lit, own)))) / F.least(F.lit(len(own)), F.greatest(F.size("pairs"), F.lit(1)))
            shares.append(F.when(F.col("best") == family, share).otherwise(0.0))
    family = F.when(F.col("probability") < UNKNOWN_BELOW, "unknown").otherwise(F.col("best"))
    confirmed = (F.col("probability") >= UNKNOWN_BELOW) & (F.greatest(*shares) >= CONFIRM_FROM)
    judged = settle(found.select("doc", "row", "at", "upto", "run", "paragraph", family.alias("family"), "probability", confirmed.alias("confirmed")))
    lines = judged.where("not run and confirmed").select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.col("at").alias("_at"), F.col("family").alias("_family")).hint("merge")
    held = (F.col("row") == F.col("_row")) & F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("family") == F.col("_family")) & F.col("_at").between(F.col("at"), F.col("upto") - 1)
    runs = judged.where("run and confirmed").join(lines, held, "left_anti")
    return judged.where("not run").unionByName(runs).drop("run", "upto")


def licence_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document id: ``doc_id, n_findings, n_confirmed, families``.

    ``families`` are the confirmed ones, sorted and comma-joined. Null and empty texts have no
    findings; rows that repeat an id are one document; an empty table gives none.
    """
    found = licence_findings(docs, doc_id, text)
    by = found.groupBy("doc").agg(F.count("*").alias("n_findings"), F.count_if("confirmed").alias("n_confirmed"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"))
    ids = docs.select(doc_id).distinct()
    joined = ids.join(by.hint("merge"), ids[doc_id].eqNullSafe(by["doc"]), "left")
    return joined.select(doc_id, F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"))
