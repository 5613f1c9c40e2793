"""Licence scanning by sparse TF-IDF cosine, in DataFrame functions only.

Headers are the lines of a text, and the windows around licence words in long lines. Each different
header, and each whole text, is a sparse TF-IDF vector and is compared with licence templates by cosine; the best
template at ``MATCH`` or above names it. Document frequencies are those over the lines with licence words
and the templates; a word that is in none of them has frequency 0. They weigh the words and leave no text out. A file that is itself a licence file (by
its name, or a whole text near a template) licenses its directory, and a file
without a header of its own takes the licence of its nearest such ancestor
directory, found by equi-joins of paths with all their ancestors. A file named as a licence grants what its best header or whole text says.

Equal headers are compared once, so lines that many texts share cost one row; the templates
are a fixed list and are the only data sent to all executors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored

MATCH = 0.5
WHOLE = 0.8
#: Words whose lines give the document frequencies, windows around them, and names of licence files (fixed values).
CUE = r"(?i)licen[cs]e|copyright|spdx|public domain|all rights reserved|creativecommons"
HEADER = r"(?i)([^\n]{0,160}(?:licen[cs]e|copyright|spdx|public domain|all rights reserved|creativecommons)[^\n]{0,240})"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
#: Short notices of public licences by SPDX identifier (fixed values).
TEMPLATES = [
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software mit license"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the license apache license version 2.0"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-2.0", "this program is free software licensed under the gnu general public license version 2"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms bsd 3 clause license"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms bsd 2 clause license"),
    ("MPL-2.0", "subject to the terms of the mozilla public license version 2.0"),
    ("ISC", "released under the isc license"),
    ("CC0-1.0", "creative commons cc0 1.0 universal public domain dedication"),
    ("CC-BY-4.0", "licensed under cc by 4.0 creative commons attribution 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0 creative commons attribution sharealike 4.0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4.0 international license"),
    ("CC-BY-ND-4.0", "licensed under cc by nd 4.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("LicenseRef-proprietary", "copyright all rights reserved proprietary and confidential"),
]


def _terms(text) -> F.Column:
    """Words of a header: letters, or numbers with their point."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def _key_pattern(weights: dict[str, float], unit_templates: dict[str, list[float]], match: float) -> str:
    """A pattern of words of which a text must hold one to reach ``match`` with any template.

    A text whose terms in common with a template carry the share s of its squared norm has a cosine of at most
    sqrt(s) with it. The words are each template's heaviest ones, so many that the others' share is too small.
    """
    words: set[str] = set()
    for template in range(len(next(iter(unit_templates.values())))):
        others = sorted(((v[template] / weights[term], term) for term, v in unit_templates.items() if v[template]), reverse=True)
        while sum(v * v for v, _ in others) >= (match - 1e-6) ** 2:
            words.add(others.pop(0)[1])
    numbers = [w.replace(".", r"\.") for w in sorted(words) if w[0].isdigit()]
    return "|".join(["(?<![a-z])(?:" + "|".join(sorted(w for w in words if not w[0].isdigit())) + ")(?![a-z])", *numbers])


def _candidates(rows: DataFrame, windows, weights: dict[str, float], unit_templates: dict[str, list[float]], low: float, match: float) -> DataFrame:
    """key, path, header, all of the lines, windows and whole texts that can reach ``match`` with some template.

    The dot product has template terms only and is exact here. Of the norm, the part of the template terms is
    exact; the m other terms, d of them different, add m * m / d * low ** 2 to its square at least,
    where ``low`` is the least weight of any other term. So no text that could match is left out.
    """
    # each step's arrays are made once: a predicate on a plain column would be moved below and work its expressions out
    # again for each mention, and an inner explode would test its array's size first
    once = lambda **columns: F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("o")
    has_key = lambda x: F.lower(x).rlike(_key_pattern(weights, unit_templates, match))
    unit = lambda x, whole, terms: F.struct(x.alias("header"), F.lit(whole).alias("all"), terms.alias("terms"))
    cut = rows.where(has_key(F.col("text"))).select("key", "path", "text", once(lines=F.filter(F.split("text", "\n", -1), has_key)))
    line_units = F.transform("o.lines", lambda x: unit(F.trim(x), False, _terms(x)))
    window_units = F.transform(windows(F.col("o.lines")), lambda x: unit(x, False, _terms(x)))
    parts = F.concat(line_units, window_units, F.array(unit(F.col("text"), True, _terms(F.col("text")))))
    units = cut.select("key", "path", F.explode_outer(parts).alias("u"))
    own = F.filter("u.terms", lambda x: x.isin(list(weights)))
    others = F.size(F.array_except("u.terms", F.array(*map(F.lit, weights))))
    units = units.select("key", "path", "u.header", "u.all", once(own=own, rest=others, size=F.size("u.terms"))).select("key", "path", "header", "all", "o.*").where(F.size("own") > 0)
    count = lambda x: F.struct(x.alias("term"), (F.size("own") - F.size(F.array_remove(F.col("own"), x))).cast("double").alias("tf"))
    m = (F.col("size") - F.size("own")).cast("double")
    other = F.lit(low * low) * m * m / F.greatest("rest", F.lit(1))
    units = units.select("key", "path", "header", "all", once(counts=F.transform(F.array_distinct("own"), count), other=other)).select("key", "path", "header", "all", "o.*")
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    square = F.aggregate("counts", F.lit(0.0), lambda total, x: total + F.pow(x["tf"] * known[x["term"]], 2))
    units = units.select("key", "path", "header", "all", once(counts=F.col("counts"), other=F.col("other"), square=square)).select("key", "path", "header", "all", "o.*")
    least = (match - 1e-6) ** 2  # cosines are rounded to six places
    shares = F.create_map(*[x for term, v in unit_templates.items() for x in (F.lit(term), F.array(*map(F.lit, v)))])
    zeros = F.array(*[F.lit(0.0)] * len(next(iter(unit_templates.values()))))
    dots = F.aggregate("counts", zeros, lambda total, x: F.zip_with(total, shares[x["term"]], lambda p, q: p + x["tf"] * q))
    return units.where((F.col("square") * (1 - least) >= F.col("other") * least) & (F.pow(F.array_max(dots), 2) >= (F.col("square") + F.col("other")) * least))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, match: float = MATCH, whole: float = WHOLE) -> DataFrame:
    """id, path, header_license, header_cosine, headers, license, basis, from_directory of every row of (id, path, text).

    ``basis`` is header, directory or none. Among a text's headers public licences go before others, then the largest cosine
    wins, then the earlier licence name. Null text or path: no header, no ancestors.
    Among several licence files of a directory the same order holds. Empty and very long texts, and very long lines, are compared whole like
    others; repeated rows and ids each come back; an empty table gives no rows; other columns are not read.
    """
    spark = files.sparkSession
    # rows are met again by a key of all they hold, so null ids and paths and repeated ids do no harm
    rows = files.select("id", "path", "text", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("\x00")), F.coalesce("path", F.lit("\x00")), F.coalesce("text", F.lit("\x00"))).alias("key"))
    windows = lambda lines: F.flatten(F.transform(F.filter(lines, lambda x: x.rlike(CUE)), lambda x: F.transform(F.regexp_extract_all(x, F.lit(HEADER), F.lit(1)), F.trim)))
    # document frequencies come from the cued headers; what is compared does not depend on cues
    cued = rows.where(F.col("text").rlike(CUE)).select(F.explode(windows(F.split("text", "\n", -1))).alias("header"))
    different = stored(cued.distinct().withColumn("hid", F.xxhash64("header")), "cued")
    terms = different.select("hid", F.explode(_terms(F.col("header"))).alias("term")).groupBy("hid", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, name string, text string")
    known_terms = known.select("template", "name", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "name", "term").agg(F.count(F.lit(1)).cast("double").alias("ttf"))
    idf_in = terms.select("term", F.lit(1).alias("one")).unionByName(known_terms.select("term", F.lit(1).alias("one")))
    idf_in = idf_in.groupBy("term").agg(F.sum("one").cast("double").alias("df"))
    n = float(different.count() + len(templates))
    idf = stored(idf_in.select("term", F.log((F.lit(n) + 1) / (F.col("df") + 0.5)).alias("idf")), "idf")
    low = idf_in.join(F.broadcast(known_terms.select("term").distinct()), "term", "left_anti").agg(F.log((F.lit(n) + 1) / (F.coalesce(F.max("df"), F.lit(0.0)) + 0.5)).alias("idf")).first()["idf"]
    rare = math.log((n + 1) / 0.5)  # of a term that no cued header has
    known_w = known_terms.join(idf, "term").select("template", "name", "term", "idf", (F.col("ttf") * F.col("idf")).alias("tw"))
    known_norm = known_w.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    weights, shares = {}, {}
    for r in known_w.join(known_norm, "template").collect():  # the templates' terms
        weights[r["term"]] = r["idf"]
        shares.setdefault(r["term"], [0.0] * len(templates))[r["template"]] = r["idf"] * r["tw"] / r["tnorm"]
    units = _candidates(rows, windows, weights, shares, low, match).withColumn("hid", F.xxhash64("header"))
    headers = stored(units.select("key", "path", "header", "all", "hid"), "headers").distinct()
    terms = headers.groupBy("hid").agg(F.min("header").alias("header")).select("hid", F.explode(_terms(F.col("header"))).alias("term")).groupBy("hid", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    weighed = terms.join(idf, "term", "left").select("hid", "term", (F.col("tf") * F.coalesce("idf", F.lit(rare))).alias("w"))
    norm = weighed.groupBy("hid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # a handful of templates' terms: bounded by the templates' length
    dots = weighed.join(F.broadcast(known_w.drop("idf")), "term").groupBy("hid", "template", "name").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = dots.join(norm, "hid").join(F.broadcast(known_norm), "template").select("hid", "name", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("cosine"))
    best = cosine.groupBy("hid").agg(F.max("cosine").alias("cosine"))
    best = cosine.join(best, ["hid", "cosine"]).groupBy("hid", "cosine").agg(F.min("name").alias("name")).where(F.col("cosine") >= match)
    best = stored(best, "best")
    discard(different, idf)
    matched = headers.drop("header").join(best, "hid")
    # "all rights reserved" stands in texts under public licences too, so those go first
    matched = matched.withColumn("public", ~F.startswith("name", F.lit("LicenseRef")))
    first = F.max(F.struct("public", "cosine")).alias("first")
    per_row = matched.where(~F.col("all")).groupBy("key").agg(first, F.count(F.lit(1)).alias("headers")).select("key", "first.*", "headers")
    top = matched.where(~F.col("all")).join(per_row, ["key", "public", "cosine"]).groupBy("key", "cosine", "headers").agg(F.min("name").alias("name"))
    named = matched.where((F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)) | (F.col("all") & (F.col("cosine") >= whole))) & F.col("path").contains("/"))
    directory = named.withColumn("directory", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    high = directory.groupBy("directory").agg(first).select("directory", "first.*")
    granted = directory.join(high, ["directory", "public", "cosine"]).groupBy("directory").agg(F.min("name").alias("granted"))
    # every directory of the corpus with each of its ancestors, once; then the nearest that grants a licence
    home = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    homes = rows.select(home.alias("home")).where("home is not null").distinct()
    steps = F.split("home", "/")
    up = homes.select("home", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth"))
    up = up.select("home", "depth", F.array_join(F.slice(F.split("home", "/"), F.lit(1), F.col("depth")), "/").alias("directory"))
    near = up.join(granted, "directory")
    deepest = near.groupBy("home").agg(F.max("depth").alias("depth"))
    inherited = near.join(deepest, ["home", "depth"]).select("home", F.col("directory").alias("from_directory"), "granted")
    out = rows.select("id", "path", "key", home.alias("home")).join(top, "key", "left")
    out = out.join(inherited, "home", "left")
    basis = F.when(F.col("name").isNotNull(), "header").when(F.col("granted").isNotNull(), "directory").otherwise("none")
    return out.select(
        "id", "path", F.col("name").alias("header_license"), F.col("cosine").alias("header_cosine"), F.coalesce("headers", F.lit(0)).alias("headers"),
        F.coalesce("name", "granted").alias("license"), basis.alias("basis"), F.when(F.col("name").isNull(), F.col("from_directory")).alias("from_directory"),
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """``scan`` of documents, filed as source/lang/doc_id.txt; the id comes back as doc_id."""
    name = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("unknown")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")), F.lit(".txt"))
    return scan(docs.select(F.col("doc_id").alias("id"), name.alias("path"), "text")).withColumnRenamed("id", "doc_id")
