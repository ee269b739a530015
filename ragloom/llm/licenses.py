"""Licence scans: a trained paragraph classifier, in DataFrame, SQL and Spark ML functions only.

A paragraph (a line of a text) becomes a sparse binary vector of its word uni- and bigrams. A multinomial logistic regression,
fitted by Spark ML on the licence templates in many wordings and on all paragraphs of the corpus, names its licence family or
`none`. Features are the uni- and bigrams of the templates and of some other sentences with their words, so paragraphs that are alike in
these are one weighted row and the fit has all of the corpus in few rows. The `unknown` class is calibrated: of these rows, which mostly hold no
licence, one half trains and the other sets the bar that a paragraph's probability of being any licence must reach, so that `ORDINARY`
of its paragraphs stay under it. A family's prediction holds only with a probability of 0.5 and if a template of that family confirms it: at least `CONFIRM` of
a template's words stand in the paragraph. What reaches the bar but no family is `unknown`.

Two more readings join a text's lines up to a blank line. A sentence that runs over a line break is classified like a paragraph, and
counts if only its lines together confirm a family. A block that holds at least `CONFIRM` of the word 4-grams of a family's licence
text (`TEXTS`) is of that family, whatever its name. Unknown lines within either are not reported besides. The bodies of the GPL
and CC BY texts are alike between their variants, so only their paragraphs with a name in them tell the family.

Nothing is sampled: counts, model and bar come from every paragraph of every document, and classification covers them all.

Defined results: null and empty texts have no licence; repeated rows and doc_ids count as one document; empty tables give empty
results (the model then has the templates and the fixed other sentences only); other columns are ignored.
"""

from __future__ import annotations

from itertools import product

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FEATURES = 1 << 13
#: What all paragraphs of the corpus weigh together in the fit at most; a template's wording weighs 1, a paragraph half of that at most.
CORPUS_WEIGHT = 1_000.0
#: Share of the held paragraphs that stays under the bar, but for a margin of 0.05.
ORDINARY = 0.9995
CONFIRM = 0.75
WORD = r"[\p{L}\p{N}]+"
NONE, UNKNOWN = "none", "unknown"

# Names of licences as they are commonly written, by family.
NAMES = {
    "MIT": ["MIT License", "MIT Licence", "Expat MIT License"],
    "Apache": ["Apache License Version 2.0", "Apache License 2.0", "Apache Software License"],
    "GPL": ["GNU General Public License", "GNU General Public License version 3", "GNU General Public License version 2", "GNU GPL v3"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License version 3", "GNU LGPL"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License version 3", "GNU AGPL v3"],
    "BSD": ["BSD License", "BSD 3 Clause License", "BSD 2 Clause License", "New BSD License"],
    "MPL": ["Mozilla Public License", "Mozilla Public License Version 2.0"],
    "ISC": ["ISC License"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution NonCommercial License"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0", "Creative Commons Attribution NonCommercial ShareAlike License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution NoDerivatives License"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero Public Domain Dedication"],
    "Unlicense": ["Unlicense"],
}
OPENINGS = ["Released under the", "Licensed under the", "Licensed under", "This work is licensed under the", "Distributed under the terms of the", "Available under the", "License:", "This software is made available under the", ""]
# Paragraphs of licence texts that do not hold the licence's name.
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("Apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("MPL", "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions"),
    ("CC0", "Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights and associated claims and causes of action"),
]
#: What every text, or every wording of a name, has at least one of.
TEXT_CUE = r"(?i)hereby|redistribution|unencumbered|free\W+to\W+copy"
NAME_CUE = r"(?i)licen[cs]e|gnu|gpl|\bcc|commons|rights"
BLANK = r"\n[ \t\r]*\n"
SENTENCE = r"(?<=[.!?;:])\s+"
RESERVED = ["All rights reserved.", "Copyright. All rights reserved.", "All rights are reserved by the author.", "No part may be reproduced without permission. All rights reserved."]
OTHER = [
    "The license plate of the car was stolen.", "A driving license is required.", "He was released under bail.", "The work is under way.",
    "This work is great.", "The public library is open to the general public.", "Version 2.0 of the program is out.", "The terms of the contract.",
    "The lesser of two evils.", "She has a fishing license for the lake.", "In general the public was amused.", "A new clause was added to the contract.",
    "The software is distributed to all users.", "He reserved all the rooms.", "The artistic license of the poet.", "The creative commons of the village.",
]


def templates(spark: SparkSession) -> DataFrame:
    """(family, paragraph) of every licence name in every wording; a small inline table."""
    rows = [(f, f"{o} {n}.".strip()) for f, names in NAMES.items() for n, o in product(names, OPENINGS)]
    rows += [("proprietary", r) for r in RESERVED]
    return spark.createDataFrame(rows, "family string, paragraph string")


def core(words: list[str]) -> list[str]:
    return sorted(set(words))


def template_words() -> F.Column:
    """family -> word sets of its names, as a literal map."""
    import re

    sets = {f: [core(re.findall(r"\w+", n.lower())) for n in names] for f, names in NAMES.items()} | {"proprietary": [["all", "reserved", "rights"]]}
    pairs = []
    for f in sorted(sets):
        pairs += [F.lit(f), F.array(*[F.array(*map(F.lit, s)) for s in sets[f]])]
    return F.create_map(*pairs)


def words_of(paragraph) -> F.Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(WORD), F.lit(0))


def paragraphs(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("place", "paragraph"))
    return lines.where("trim(paragraph) <> ''")


def text_shares(normal) -> list[tuple[str, F.Column, F.Column]]:
    """(family, 4-grams found, share of all its 4-grams) of each licence text in `normal`, a lambda's variable with a
    value of `normalise`; a column would be worked out anew for every 4-gram."""
    import re

    out = []
    for family, body in TEXTS:
        w = re.findall(r"[^\W_]+", body.lower())
        grams = sorted({f" {' '.join(w[i : i + 4])} " for i in range(len(w) - 3)})
        found = F.size(F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(normal, g)))
        out.append((family, found, found / F.lit(len(grams))))
    return out


def normalise(body) -> F.Column:
    """The words in lower case with one space around each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def units(docs: DataFrame) -> DataFrame:
    """What is classified: doc_id, block, place, kind, paragraph, family, share. The non-blank lines of every block of lines, its
    sentences over more than one line that speak of licences, and (with their family) the licence texts that it holds."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(text, BLANK, -1)).alias("block", "body")).where("trim(body) <> ''")

    def unit(place, kind, paragraph, family=None, share=None):
        return F.struct(place.cast("int").alias("place"), F.lit(kind).alias("kind"), paragraph.alias("paragraph"), F.lit(family).cast("string").alias("family"), (F.lit(0.0) if share is None else share).alias("share"))

    body = F.col("body")
    lines = F.filter(F.transform(F.split(body, "\n", -1), lambda x, i: unit(i, "line", x)), lambda u: F.trim(u["paragraph"]) != "")
    over = F.filter(F.transform(F.split(body, SENTENCE, -1), lambda x, i: unit(i, "sentence", x)), lambda u: F.contains(u["paragraph"], F.lit("\n")))
    over = F.when(F.contains(body, F.lit("\n")) & body.rlike(NAME_CUE), F.filter(over, lambda u: u["paragraph"].rlike(NAME_CUE)))
    of = lambda x: F.array(*[unit(F.lit(i), "text", body, family, share) for i, (family, _, share) in enumerate(text_shares(x))])
    found = F.flatten(F.transform(F.array(normalise(body)), lambda x: F.filter(of(x), lambda u: u["share"] >= CONFIRM)))
    found = F.when(body.rlike(TEXT_CUE), found)
    empty = F.array().cast("array<struct<place:int,kind:string,paragraph:string,family:string,share:double>>")
    return blocks.select("doc_id", "block", F.inline(F.concat(lines, F.coalesce(over, empty), F.coalesce(found, empty))))


def vocabulary() -> list[str]:
    """Uni- and bigrams of the templates and the other sentences."""
    import re

    grams = set()
    for x in [*(f"{o} {n}." for names in NAMES.values() for n, o in product(names, OPENINGS)), *RESERVED, *OTHER]:
        w = re.findall(r"[^\W_]+", x.lower())
        grams |= {*w, *map(" ".join, zip(w, w[1:]))}
    return sorted(grams)


def with_grams(rows: DataFrame) -> DataFrame:
    """`rows` (..., paragraph) with `words` and `grams`: the set of its grams in the vocabulary, sorted."""
    rows = rows.withColumn("words", words_of(F.col("paragraph")))
    rows = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows)
    known = vocabulary()
    found = F.filter(F.concat("words", "pairs"), lambda g: g.isin(known))
    return rows.withColumn("grams", F.array_sort(F.array_distinct(found))).drop("pairs")


def featurise(rows: DataFrame) -> DataFrame:
    """`rows` (..., grams) with the sparse vector `features` in their place."""
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(rows).drop("grams")


def corpus(docs: DataFrame) -> DataFrame:
    """(grams, n, half) of all paragraphs without a licence's name or a piece of its text in them: how many have these grams."""
    most = lambda x: F.element_at(F.transform(F.array(normalise(x)), lambda y: F.greatest(*[n for _, n, _ in text_shares(y)])), 1)
    piece = F.when(F.col("paragraph").rlike(TEXT_CUE), most(F.col("paragraph")) >= 3).otherwise(F.lit(False))
    rows = with_grams(paragraphs(docs).where(~piece)).groupBy("grams").agg(F.count("*").alias("n"))
    rows = common.materialise(rows, "licence-grams")  # counted before the names are looked for, which costs more than a paragraph
    sets = F.flatten(F.map_values(template_words()))
    rows = rows.where(~F.exists(sets, lambda s: F.size(F.array_intersect(s, F.col("grams"))) >= F.lit(CONFIRM) * F.size(s)))
    return rows.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), F.col("grams")), F.lit(2)))


class Classifier:
    def __init__(self, model, families: list[str], bar: float):
        self.model, self.families, self.bar = model, families, bar


def fit(docs: DataFrame) -> Classifier:
    spark = docs.sparkSession
    families = [NONE, *sorted([*NAMES, "proprietary"])]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    own = corpus(docs).cache()
    total = own.where("half = 0").agg(F.sum("n")).first()[0] or 1
    known = templates(spark).withColumn("weight", F.lit(1.0))
    other = spark.createDataFrame([(NONE, x) for x in OTHER], "family string, paragraph string").withColumn("weight", F.lit(5.0))
    fixed = with_grams(known.unionByName(other)).select("family", "grams", "weight")
    train = fixed.unionByName(own.where("half = 0").select(F.lit(NONE).alias("family"), "grams", (F.col("n") * F.lit(min(0.5, CORPUS_WEIGHT / total))).alias("weight")))
    rows = featurise(train.withColumn("label", label)).select("label", "weight", "features").repartition(common.partitions(spark)).cache()
    model = LogisticRegression(maxIter=60, regParam=0.0005, weightCol="weight", family="multinomial", standardization=False).fit(rows)
    rows.unpersist()
    held = model.transform(featurise(own.where("half = 1"))).select("n", F.round(1 - vector_to_array("probability")[0], 4).alias("p"))
    # at most 10,001 values of p, each with its count of paragraphs
    bar = held.groupBy("p").agg(F.sum("n").alias("n")).agg(F.percentile("p", F.lit(ORDINARY), F.col("n"))).first()[0]
    own.unpersist()
    return Classifier(model, families, max(0.5, min(0.9, (bar or 0.0) + 0.05)))


def classify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Paragraphs that speak of licences: doc_id, block, kind, place, paragraph, family (or unknown), probability."""
    scored = classifier.model.transform(featurise(with_grams(units(docs).withColumnRenamed("family", "held"))))
    names = F.array(*map(F.lit, classifier.families))
    scored = scored.select("doc_id", "block", "kind", "place", "paragraph", "held", "share", "words", vector_to_array("probability").alias("p"))
    scored = scored.where((F.col("kind") == "text") | (1 - F.col("p")[0] >= F.lit(classifier.bar)))
    rest = F.slice("p", 2, len(classifier.families) - 1)
    scored = scored.withColumn("best", F.array_max(rest)).withColumn("guess", F.element_at(names, F.array_position(rest, F.col("best")).cast("int") + 1))
    sets = F.element_at(template_words(), F.col("guess"))
    holds = lambda words: F.exists(sets, lambda s: F.size(F.array_intersect(s, words)) >= F.lit(CONFIRM) * F.size(s))
    confirmed = (F.col("best") >= 0.5) & holds(F.col("words"))
    text, sentence = F.col("kind") == "text", F.col("kind") == "sentence"
    alone = F.exists(F.split("paragraph", "\n", -1), lambda x: holds(words_of(x)))
    family = F.when(text, F.col("held")).when(sentence & (~confirmed | alone), None).when(confirmed, F.col("guess")).otherwise(F.lit(UNKNOWN))
    found = scored.select("doc_id", "block", "kind", "place", "paragraph", family.alias("family"), F.round(F.when(text, F.col("share")).otherwise(F.col("best")), 6).alias("probability"))
    # unknown lines of a sentence or text that has a family
    wide = F.collect_set(F.when((F.col("kind") != "line") & F.col("family").isNotNull(), F.col("paragraph"))).over(Window.partitionBy("doc_id", "block"))
    within = F.exists("wide", lambda x: F.contains(x, F.col("paragraph")))
    return found.withColumn("wide", wide).where(F.col("family").isNotNull() & ~((F.col("kind") == "line") & (F.col("family") == UNKNOWN) & within)).drop("wide")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licence (families of its paragraphs, sorted, comma-joined; `none`), n_paragraphs: every document once."""
    found = classify(docs, fit(docs)).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licence"), F.count_distinct("block", "kind", "place").alias("n_paragraphs")
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("doc_id")), "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("licence", F.lit(NONE)).alias("licence"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"))
