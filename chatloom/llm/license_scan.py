"""Licence scans with DataFrame expressions only.

Candidate units are the header lines of all files that speak of a licence, and the whole
text of licence files. Units and templates become sparse TF-IDF vectors (document
frequencies over all units, each distinct unit held once with its count); the best cosine at or above
a threshold names the licence. A file without one of its own inherits from the licence
file of its nearest ancestor directory, by a join on paths.

Defined cases: a null or empty text has no licence of its own; a null path inherits
nothing; ties go to the first licence name; two licence files in a directory: the higher
cosine; repeated rows give repeated results; an empty table gives no rows; extra columns
with any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.common import documents
from chatloom.session import staged

# Header wordings by licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain under the Unlicense",
}
HINT = r"(?i)licen[sc]e|creative commons|public domain|redistribution and use"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying)(?:\.[a-z]+)?$"
COSINE = 0.6


def _vectors(units: DataFrame) -> DataFrame:
    """(unit, term, tf, n) of distinct units (unit, n, words)."""
    terms = F.regexp_extract_all(F.lower("words"), F.lit(f"({TERM})"), 1)
    return units.select("unit", "n", F.explode(terms).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))


def best_licence(units: DataFrame, templates: dict[str, str] = TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """(unit, licence, cosine) of distinct units (unit, n, words) that match a template.

    unit is a short key: it is repeated for every term, which the words themselves must not be.
    """
    spark = units.sparkSession
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"))
    vectors = staged(_vectors(units))
    idf = vectors.groupBy("term").agg(F.sum("n").alias("df"))
    wanted = spark.createDataFrame([(k, k, v) for k, v in templates.items()], "licence string, unit string, words string").withColumn("n", F.lit(0).cast("long"))
    weigh = lambda df: df.join(idf, "term", "left").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1)).select("unit", "term", "w")
    template = staged(weigh(_vectors(wanted)).select(F.col("unit").alias("licence"), "term", F.col("w").alias("tw")))
    norm = F.broadcast(template.groupBy("licence").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm")))  # one row a template
    weighed = staged(weigh(vectors))
    own = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(template), "term").groupBy("unit", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    rated = dots.join(norm, "licence").join(own, "unit").withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6)).filter(F.col("cosine") >= cosine)
    first = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("cosine"), "licence"))
    return rated.withColumn("k", first).filter("k = 1").select("unit", "licence", "cosine")


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """files (doc_id, path, text) -> (doc_id, path, own_license, own_cosine, license, license_dir) for every row."""
    path = F.col("path")
    t = F.coalesce("text", F.lit(""))
    file = path.rlike(LICENCE_FILE)
    hinted = t.rlike(HINT)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(HINT))
    found = files.select("doc_id", "path", F.when(hinted, F.array_distinct(F.concat(lines, F.when(file, F.array(t)).otherwise(F.array())))).otherwise(F.array().cast("array<string>")).alias("units"))
    found = staged(found)
    texts = found.select("doc_id", "path", F.explode("units").alias("words")).withColumn("unit", F.md5("words"))
    units = texts.select("doc_id", "path", "unit")
    best = staged(best_licence(staged(texts.groupBy("unit").agg(F.count("*").alias("n"), F.first("words").alias("words"))), templates, cosine))
    top = F.max_by(F.struct("licence", "cosine"), F.struct(F.col("cosine"), F.col("back")))
    # Later names sort lower, so that a tie goes to the first name.
    named = best.withColumn("back", -F.array_position(F.lit(sorted(templates)), F.col("licence")))
    own = staged(units.join(named, "unit").groupBy("doc_id", "path").agg(top.alias("own")))
    rows = found.select("doc_id", "path").alias("f").join(own.alias("o"), (F.col("f.doc_id").eqNullSafe(F.col("o.doc_id"))) & (F.col("f.path").eqNullSafe(F.col("o.path"))), "left")
    rows = staged(rows.select("f.doc_id", "f.path", F.col("own.licence").alias("own_license"), F.col("own.cosine").alias("own_cosine")))
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    dirs = rows.filter(F.col("path").rlike(LICENCE_FILE) & F.col("own_license").isNotNull()).groupBy(parent.alias("dir")).agg(F.max_by("own_license", F.struct(F.col("own_cosine"), -F.array_position(F.lit(sorted(templates)), F.col("own_license")))).alias("dir_license"))
    dirs = staged(dirs)
    bare = rows.filter(F.col("own_license").isNull() & F.col("path").isNotNull()).select("path").groupBy("path").agg(F.lit(1).alias("one"))
    parts = F.split(parent, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.concat_ws("/", F.slice(parts, 1, k)).alias("dir"), k.alias("depth")))
    near = bare.select("path", F.explode(F.array_distinct(above)).alias("a")).select("path", "a.dir", "a.depth").join(dirs, "dir")
    near = staged(near.groupBy("path").agg(F.max_by(F.struct("dir", "dir_license"), "depth").alias("near")))
    out = rows.join(near, "path", "left")
    inherits = F.col("own_license").isNull()
    return out.select("doc_id", "path", "own_license", "own_cosine", F.coalesce("own_license", "near.dir_license").alias("license"), F.when(inherits, F.col("near.dir")).alias("license_dir"))


def tree_path(doc_id: Column, source: Column) -> Column:
    """Where a document lies in its source's tree: packages of 512, modules of 32, each with a licence file."""
    number = lambda n: F.floor(doc_id / n).cast("string")
    package = F.concat(source, F.lit("/p"), number(512))
    module = F.concat(package, F.lit("/m"), number(32))
    return (
        F.when(F.pmod(doc_id, F.lit(512)) == 16, F.concat(package, F.lit("/LICENSE")))
        .when(F.pmod(doc_id, F.lit(32)) == 0, F.concat(module, F.lit("/LICENSE")))
        .when(F.pmod(doc_id, F.lit(4096)) == 40, F.concat(source, F.lit("/COPYING")))
        .otherwise(F.concat(module, F.lit("/"), doc_id.cast("string"), F.lit(".txt")))
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs.select("doc_id", tree_path(F.col("doc_id"), F.col("source")).alias("path"), "text"))


def _sql() -> str:
    values = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
    term = f"regexp_extract_all(lower(unit), '{TERM}')"
    return f"""
with f as (select doc_id, coalesce(text, '') t, case when doc_id % 512 = 16 then source || '/p' || (doc_id // 512) || '/LICENSE'
    when doc_id % 32 = 0 then source || '/p' || (doc_id // 512) || '/m' || (doc_id // 32) || '/LICENSE'
    when doc_id % 4096 = 40 then source || '/COPYING'
    else source || '/p' || (doc_id // 512) || '/m' || (doc_id // 32) || '/' || doc_id || '.txt' end as path from documents),
u as (select distinct doc_id, path, unit from (
    select doc_id, path, unnest(string_split(t, chr(10))) unit from f
    union all select doc_id, path, t from f where regexp_matches(path, '{LICENCE_FILE}'))
    where regexp_matches(unit, '{HINT}')),
d as (select unit, count(*) n from u group by unit),
tpl(licence, unit) as (values {values}),
ut as (select unit, n, unnest({term}) term from d),
uv as (select unit, term, count(*) tf, any_value(n) n from ut group by unit, term),
idf as (select term, sum(n) df from uv group by term),
tot as (select coalesce(sum(n), 0)::double total from d),
tt as (select licence, unnest({term}) term from tpl),
tv as (select licence, term, count(*) * (ln((1 + total) / (1 + coalesce(any_value(df), 0))) + 1) w from tt left join idf using (term), tot group by licence, term, total),
tn as (select licence, sqrt(sum(w * w)) nrm from tv group by licence),
w as (select unit, term, tf * (ln((1 + total) / (1 + df)) + 1) w from uv join idf using (term), tot),
un as (select unit, sqrt(sum(w * w)) nrm from w group by unit),
r as (select unit, licence, round(sum(w.w * tv.w) / (any_value(un.nrm) * any_value(tn.nrm)), 6) cosine
    from w join tv using (term) join un using (unit) join tn using (licence) group by unit, licence),
own as (select doc_id, path, licence, cosine from u join r using (unit) where cosine >= {COSINE}
    qualify row_number() over (partition by doc_id, path order by cosine desc, licence) = 1),
g as (select f.doc_id, f.path, own.licence own_license, own.cosine own_cosine, regexp_replace(f.path, '/?[^/]*$', '') parent
    from f left join own on f.doc_id = own.doc_id and f.path = own.path),
dirs as (select parent dir, own_license dir_license from g where own_license is not null and regexp_matches(path, '{LICENCE_FILE}')
    qualify row_number() over (partition by parent order by own_cosine desc, own_license) = 1),
near as (select g.doc_id, g.path, dir, dir_license from g join dirs on g.parent = dir or starts_with(g.parent, dir || '/') where own_license is null
    qualify row_number() over (partition by g.doc_id, g.path order by length(dir) desc) = 1)
select g.doc_id, g.path, own_license, own_cosine, coalesce(own_license, dir_license) as license, dir as license_dir
from g left join near on g.doc_id = near.doc_id and g.path = near.path
"""


OP4_SQL = _sql()
