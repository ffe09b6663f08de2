"""Licences of files: TF-IDF cosine to templates, then inheritance from the nearest directory above.

DataFrame functions only. A text is split into terms once, and windows of it as long as a template
are compared with that template by the cosine of their TF-IDF vectors. Line ends, comment signs and
the words around play no part, so a one-line header, a notice wrapped over a comment block, a
statement within a sentence and the text of a licence file are all found the same way. A window can
only reach a template's threshold if it holds one of its heavy terms (those without which the rest of
its vector is shorter than the threshold), so windows are laid where a heavy term of the text
stands in the place that it has in the template; their cosines are exact. A file without a licence of
its own takes that of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stage, table

LEAST_COSINE = 0.8
_GNU = "{what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{mark2} either version {version} of the License, or (at your option) any later version."
#: Statements that headers and licence files make, with SPDX identifiers. The wording is
#: the licences' own.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(what="This program", mark=":", mark2=",", name="General Public License", version="3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format(what="This program", mark=";", mark2=";", name="General Public License", version="2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", _GNU.format(what="This library", mark=";", mark2=";", name="Lesser General Public License", version="2.1")),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format(what="This program", mark=":", mark2=",", name="Affero General Public License", version="3")),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0)."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License. See LICENSE for more information."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This project is licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "GNU General Public License, version 3 or later"),
    ("GPL-2.0", "GNU General Public License, version 2 or later"),
    ("GPL-2.0", "This project is licensed under the GNU General Public License v2.0."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-2-Clause", "This project is licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "This project is licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CDDL-1.0", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"),
    ("EUPL-1.2", "European Union Public Licence v. 1.2"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("Python-2.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"),
    ("NCSA", "University of Illinois/NCSA Open Source License"),
    ("MS-PL", "Microsoft Public License (Ms-PL)"),
    ("AFL-3.0", "Licensed under the Academic Free License version 3.0"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC0-1.0", "Creative Commons Zero v1.0 Universal"),
]
TEMPLATES = [(license, text, LEAST_COSINE) for license, text in TEMPLATES]
#: A line that names the identifier must name it whole; those of the GNU licences may say which versions.
TEMPLATES += [(license, f"SPDX-License-Identifier: {license}", 0.999) for license in dict.fromkeys(t[0] for t in TEMPLATES)]
TEMPLATES += [(f"{license}-{which}", f"SPDX-License-Identifier: {license}-{which}", 0.999) for license in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for which in ("only", "or-later")]
#: Templates are a parameter and stay small: their terms are written into the plan.
MOST_TEMPLATE_TERMS = 5000
#: Up to so many hashes of texts (some 20 MB) are broadcast; beyond, texts are shuffled to them.
MOST_BROADCAST = 1_000_000
#: A file is a licence file of its directory if its name says so or so much of it is a licence statement.
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice)(\.|$)"
LICENSE_SHARE = 0.25


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for an empty text."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), "")


def _members(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _vectors(counted: DataFrame, known: DataFrame, n: int) -> tuple[DataFrame, DataFrame, Column]:
    """(template, term, w) with unit vectors; (term, idf); the idf of any other term. ``known`` has
    the vocabulary's terms of each file, ``counted`` those of the templates."""
    df = known.select(F.explode("known").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = counted.select("term").distinct().join(df, "term", "left")
    idf = stage(idf.select("term", (F.log(F.lit(n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf")), "idf")
    w = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(w * w).over(Window.partitionBy("template")))
    return stage(counted.join(F.broadcast(idf), "term").select("template", "term", "least", (w / norm).alias("w")), "vectors"), idf, F.lit(log(n + 1) + 1)


def _anchors(places: DataFrame, vectors: DataFrame) -> DataFrame:
    """(template, license, least, n, term, o, earlier) for each place of each heavy term: one of them
    must be in a window that reaches the threshold. earlier: the template's heavy places before it."""
    rest = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template").orderBy("w", "term")))
    heavy = vectors.withColumn("rest", rest).where(F.col("rest") >= F.col("least") * 0.999).select("template", "term")
    before = Window.partitionBy("template").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    rows = places.join(F.broadcast(heavy), ["template", "term"])
    return stage(rows.withColumn("earlier", F.collect_list(F.struct(F.col("o").alias("eo"), F.col("term").alias("eterm"))).over(before)), "anchors")


def own_licenses(files: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, license, cosine, words, nearest, nearest_cosine) of the best window of each file that reaches a template's
    threshold, words being the window's length: of equal cosines the longest counts, as it says more,
    then the first identifier. nearest and nearest_cosine are those of the best window of all that were laid,
    also where it falls short of its threshold, which tells why a file was refused; a file in which no heavy
    term stands has no row. Also (path, n): the terms of each file."""
    split = templates.select("template", "license", "least", terms(F.col("statement")).alias("terms"))
    places = stage(split.select("template", "license", "least", F.size("terms").alias("n"), F.posexplode("terms").alias("o", "term")), "templates")
    counted = places.groupBy("template", "least", "term").agg(F.count("*").alias("tf"))
    if not small(counted, MOST_TEMPLATE_TERMS):
        raise ValueError(f"templates have more than {MOST_TEMPLATE_TERMS} terms")
    vocabulary = [r["term"] for r in counted.select("term").distinct().orderBy("term").collect()]  # at most MOST_TEMPLATE_TERMS
    each = files.select("path", F.xxhash64("text").alias("th"), terms(F.col("text")).alias("terms"))
    known = stage(each.select("path", "th", F.size("terms").alias("n"), F.array_intersect("terms", _members(vocabulary)).alias("known")), "known")
    vectors, idf, other = _vectors(counted, known, known.count())
    anchors = _anchors(places, vectors)
    heavy = [r["term"] for r in anchors.select("term").distinct().orderBy("term").collect()]  # at most MOST_TEMPLATE_TERMS

    # Only texts that hold a heavy term are split once more: their hashes go to the texts if they are few.
    picked = stage(known.where(F.arrays_overlap("known", _members(heavy))).select(F.col("th").alias("h")).distinct(), "picked")
    picked = F.broadcast(picked) if small(picked, MOST_BROADCAST) else picked
    rows = files.withColumn("th", F.xxhash64("text")).join(picked, F.col("th") == F.col("h"), "left_semi").select("path", "th", terms(F.col("text")).alias("terms"))
    at = F.transform("terms", lambda t, i: F.when(t.isin(heavy), F.struct(i.alias("at"), t.alias("term"))))
    hits = rows.select("path", "th", "terms", F.explode(F.filter(at, lambda x: x.isNotNull())).alias("hit"))
    start = F.col("at") - F.col("o")
    earlier = F.exists("earlier", lambda e: F.coalesce(F.get("terms", start + e["eo"]) == e["eterm"], F.lit(False)))
    laid = hits.select("path", "th", "terms", "hit.at", "hit.term").join(F.broadcast(anchors), "term").where(~earlier)
    inside = F.slice("terms", F.greatest(start, F.lit(0)) + 1, F.least(start + F.col("n"), F.size("terms")) - F.greatest(start, F.lit(0)))
    # All windows of a text lie in one partition (they are no more than its terms, times the places of
    # templates), so that neither sum shuffles again.
    laid = laid.select("path", "th", "template", "license", "least", start.alias("start"), inside.alias("inside")).repartition("path", "th")
    window = ["path", "th", "template", "start", "license", "least"]
    weighed = laid.select(*window, F.explode("inside").alias("term")).groupBy(*window, "term").agg(F.count("*").alias("tf"))
    weighed = weighed.join(F.broadcast(idf), "term", "left").join(F.broadcast(vectors.drop("least")), ["template", "term"], "left")
    weight = F.col("tf") * F.coalesce("idf", other)
    scored = weighed.groupBy(*window).agg(F.sum(weight * F.col("w")).alias("dot"), F.sqrt(F.sum(weight * weight)).alias("norm"), F.sum("tf").alias("words"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    order = F.struct((-F.col("cosine")).alias("c"), (-F.col("words")).alias("w"), "license")
    best = scored.withColumn("cosine", cosine).groupBy("path").agg(F.min(F.when(F.col("cosine") >= F.col("least"), order)).alias("b"), F.min(order).alias("near"))
    best = best.select("path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), (-F.col("b.w")).alias("words"), F.col("near.license").alias("nearest"), (-F.col("near.c")).alias("nearest_cosine"))
    return best, known.groupBy("path").agg(F.sum("n").alias("n"))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def licensed(files: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """path, license, how ('own', 'inherited' or 'none'), cosine, license_dir, nearest and nearest_cosine for each path.

    ``files``: path, text, anything else; ``templates``: template, license, statement, least (the
    cosine that it takes), by default TEMPLATES. license_dir is the directory inherited from; nearest is the
    template's licence that the file comes closest to, whether or not it reaches it (null without heavy terms). Of
    several licence files in one directory the best cosine counts, then the first identifier, so that
    ties have one result. A null text has no terms; a null path is one file in the root; rows that
    repeat a path are one file; an empty table gives an empty result.
    """
    spark = files.sparkSession
    if templates is None:
        templates = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, license string, statement string, least double")
    rows = files.select(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found, sizes = own_licenses(rows, templates)
    thin = stage(sizes.join(found, "path", "left").withColumn("dir", _directory(F.col("path"))), "files")

    name = F.regexp_extract("path", "([^/]*)$", 1)
    stated = thin.where(F.col("license").isNotNull() & (name.rlike(LICENSE_NAME) | (F.col("words") >= LICENSE_SHARE * F.col("n"))))
    holders = stated.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("above_license"))
    parts = F.split("dir", "/")
    above = thin.select("dir").distinct().select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    above = above.withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")).where("depth = 0 or above <> ''")
    nearest = above.join(holders, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "above_license")).alias("b")).select(F.col("dir").alias("d"), F.col("b.above").alias("above"), F.col("b.above_license").alias("above_license"))
    out = thin.join(nearest, F.col("dir") == F.col("d"), "left")
    own = F.col("license").isNotNull()
    return out.select(
        "path",
        F.coalesce("license", "above_license").alias("license"),
        F.when(own, "own").when(F.col("above_license").isNotNull(), "inherited").otherwise("none").alias("how"),
        "cosine",
        F.when(~own, F.col("above")).alias("license_dir"),
        "nearest",
        "nearest_cosine",
    )


#: Where a document lies: source, language and a directory of 64 neighbours, whose first is its LICENSE.
_DIR = "{cat}coalesce(source, ''){sep}'/'{sep}coalesce(lang, ''){sep}'/'{sep}cast(cast(floor(doc_id / 64) as bigint) as string){end}"
DOCUMENT_PATH = _DIR.format(cat="concat(", sep=", ", end=", '/', if(doc_id % 64 = 0, 'LICENSE', concat(cast(doc_id as string), '.txt')))")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", F.expr(DOCUMENT_PATH).alias("path"))
    out = licensed(docs)
    parts = F.split("path", "/")
    first = F.element_at(parts, -2).cast("long") * 64
    doc_id = F.when(F.endswith("path", F.lit("/LICENSE")), first).otherwise(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long"))
    return out.select(doc_id.alias("doc_id"), "path", "license", "how", "cosine", "license_dir", "nearest", "nearest_cosine")


def _sql_terms(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '')"


_VALUES = ", ".join(f"({i}, '{lic}', '{text.replace(chr(39), chr(39) * 2)}', {least})" for i, (lic, text, least) in enumerate(TEMPLATES))
OP5_SQL = f"""
with named as (select doc_id, coalesce(text, '') as text, {_DIR.format(cat='', sep=' || ', end='')} as dir, case when doc_id % 64 = 0 then 'LICENSE' else cast(doc_id as varchar) || '.txt' end as name from documents),
files as (select doc_id, dir, name, dir || '/' || name as path, {_sql_terms('text')} as terms from named),
templates(template, license, statement, least) as (values {_VALUES}),
split as (select template, license, least, {_sql_terms('statement')} as terms from templates),
places as (select template, license, least, len(terms) as n, unnest(range(0, len(terms))) as o, unnest(terms) as term from split),
counted as (select template, least, term, count(*) as tf from places group by all),
file_terms as (select distinct doc_id, unnest(terms) as term from files),
df as (select term, count(*) as df from file_terms where term in (select term from counted) group by term),
total as (select count(*) as n from files),
idf as (select v.term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 as idf from (select distinct term from counted) v left join df on v.term = df.term, total),
raw as (select template, least, c.term, tf * idf as w from counted c join idf on c.term = idf.term),
vectors as (select template, least, term, w / sqrt(sum(w * w) over (partition by template)) as w from raw),
heavy as (select template, term from (select *, sqrt(sum(w * w) over (partition by template order by w, term)) as rest from vectors) where rest >= least * 0.999),
anchors as (select p.* from places p join heavy h on p.template = h.template and p.term = h.term),
file_places as (select doc_id, unnest(range(0, len(terms))) as p, unnest(terms) as term from files),
windows as (select distinct f.doc_id, a.template, a.license, a.least, a.n, f.p - a.o as start from file_places f join anchors a on f.term = a.term),
inside as (select w.doc_id, template, license, least, start, unnest(list_slice(terms, greatest(start, 0) + 1, start + w.n)) as term from windows w join files f on w.doc_id = f.doc_id),
counts as (select doc_id, template, license, least, start, term, count(*) as tf from inside group by all),
weighed as (select c.*, tf * coalesce(idf, ln(n + 1) + 1) as tw, v.w from counts c left join idf on c.term = idf.term left join vectors v on c.template = v.template and c.term = v.term, total),
scored as (select doc_id, license, least, round(sum(tw * w) / sqrt(sum(tw * tw)), 6) as cosine, sum(tf) as words from weighed group by doc_id, template, license, least, start),
own as (select * from scored where cosine >= least qualify row_number() over (partition by doc_id order by cosine desc, words desc, license) = 1),
near as (select doc_id, license as nearest, cosine as nearest_cosine from scored qualify row_number() over (partition by doc_id order by cosine desc, words desc, license) = 1),
thin as (select f.doc_id, f.path, f.dir, f.name, len(f.terms) as n, license, cosine, words, nearest, nearest_cosine from files f left join own on f.doc_id = own.doc_id left join near on f.doc_id = near.doc_id),
holders as (select dir, license from thin where license is not null and (name = 'LICENSE' or words >= {LICENSE_SHARE} * n) qualify row_number() over (partition by dir order by cosine desc, license) = 1),
dirs as (select distinct dir from thin),
nearest as (select d.dir, h.dir as above, h.license as above_license from dirs d join holders h on d.dir = h.dir or starts_with(d.dir, h.dir || '/') qualify row_number() over (partition by d.dir order by length(h.dir) desc) = 1)
select doc_id, path, coalesce(license, above_license) as license,
  case when license is not null then 'own' when above_license is not null then 'inherited' else 'none' end as how,
  cosine, case when license is null then above end as license_dir, nearest, nearest_cosine
from thin left join nearest on thin.dir = nearest.dir
"""
