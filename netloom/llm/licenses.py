r"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor folder.

A file is compared in units: its lines, its paragraphs (lines up to one without a letter or digit), its runs of comment
lines (so a header whose paragraphs are parted by bare comment signs is one unit) and its whole text, as of a licence
file; units of one line count once. Terms are lower-case runs of letters, digits and dots between them, a unit's weight
of a term its count times log((1 + N) / (1 + df)) + 1, with df counted over all N files for the templates' terms; other
terms weigh as if found in no file. Vectors are sparse rows (unit, term).

An exact check follows the cosine: a unit that lacks a term which its template must have (a version, "lesser",
"endorse") is not that licence. Only units with an anchor are scored, a term that the template must have or one of its
rarest terms; these are chosen until what is left of its vector is shorter than `least`, so by Cauchy's inequality a unit
without one stays below that cosine and nothing is lost.

Of a file's units, the one with the most evidence decides, score ** 2 times the length of the template's vector: a
whole text beats a line of it, and of two templates of which one holds the other the one that fits better wins. A bare
reservation of rights counts only where the file has nothing else.

A file without a licence of its own takes that of the nearest ancestor folder (its own folder first) that holds a
licence file: one named like LICENSE or COPYING, or, in tables without paths, a file whose deciding unit is at its start
or end. Folders are resolved once each, by joins of their ancestors' paths.

Only the templates' terms (bounded by the templates) are ever collected or broadcast. Defined results: null or empty
text has no licence of its own; ties go to the licence first in name, licence files of one folder to the first path; a
null path has no folder; repeated rows are scored each and give a folder the same licence; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import WORD, stored
from netloom.llm.license_texts import RESERVATION, TEMPLATES, Template

_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: A gap between paragraphs: no letter or digit between two line ends.
_GAP = r"\n[^A-Za-z0-9]*\n"
#: A comment line's start.
_SIGN = r"[ \t]*(?://|/\*|\*|#|--|;|<!--|%|!)"
#: Two lines with a letter or digit.
_TWO_LINES = r"[A-Za-z0-9][^\n]*\n[^A-Za-z0-9]*[A-Za-z0-9]"
#: Names of licence files.
LICENCE_FILE = r"(?i)(?:^|/)(?:li[cs]en[cs]e|copying|unlicense|copyright)[^/]*$"


def terms(text: str) -> Counter[str]:
    return Counter(re.findall(_TERM, text.lower()))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def weights(df: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, float], float]:
    """Files, the idf of each template term, and that of any other term."""
    found = df.select(F.explode(F.array_intersect(_terms(F.col(text_col)), F.array(*map(F.lit, vocabulary)))).alias("term"))
    n = df.count()
    df_of = {r["term"]: r["count"] for r in found.groupBy("term").count().collect()}
    return n, {t: math.log((1 + n) / (1 + df_of.get(t, 0))) + 1 for t in vocabulary}, math.log(1 + n) + 1


def anchors(vectors: Sequence[dict[str, int]], musts: Sequence[set[str]], idf: dict[str, float], least: float) -> set[str]:
    """Terms one of which a unit must hold to be scored: of each template, the rarest term that it must have, or its
    rarest terms without which the cosine stays below `least`, whichever occur in fewer files."""
    out: set[str] = set()
    often = lambda ts: sum(math.exp(-idf[t]) for t in ts)
    for own, must in zip(vectors, musts, strict=True):
        part = {t: (n * idf[t]) ** 2 for t, n in own.items()}
        rest = total = sum(part.values())
        rare = []
        for t in sorted(own, key=lambda t: (-idf[t], -part[t], t)):
            if rest < (least - 1e-9) ** 2 * total:
                break
            rare.append(t)
            rest -= part[t]
        choices = [rare, *([t] for t in sorted(must))]
        out.update(min(choices, key=often))
    return out


def _any_of(near: set[str]) -> str:
    """A pattern for any of the terms as a whole, by their first characters, so few are tried at a place."""
    by_first = (f"{re.escape(c)}(?:" + "|".join(re.escape(t[1:]) for t in ts) + ")" for c, ts in groupby(sorted(near, reverse=True), key=lambda t: t[0]))
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(by_first) + ")(?![a-z0-9])"


def _units(d: DataFrame, pattern: str) -> DataFrame:
    """id, file, unit, edge, terms (term, tf) of the units that hold an anchor, of rows (id, file, text)."""

    def marked(parts: Column) -> Column:
        return F.transform(parts, lambda x, k: F.struct(x.alias("text"), ((k == 0) | (k == F.size(parts) - 1)).alias("edge")))

    # Columns of one step are used more than once in the next, which keeps Spark from merging the steps.
    d = d.select("id", "file", "text", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"), F.filter(F.split("text", _GAP), lambda x: x.rlike("[A-Za-z0-9]")).alias("paragraphs"), F.split("text", rf"\n(?!{_SIGN})").alias("pieces"))
    runs = F.transform(marked(F.col("pieces")), lambda u: F.struct(F.regexp_replace(u["text"], rf"^(?!{_SIGN})[^\n]*\n?", "").alias("text"), u["edge"].alias("edge")))
    several = F.filter(F.concat(marked(F.col("paragraphs")), runs), lambda u: u["text"].rlike(_TWO_LINES))
    whole = F.when(F.size("lines") > 1, F.array(F.struct("text", F.lit(True).alias("edge")))).otherwise(F.array().cast("array<struct<text:string,edge:boolean>>"))
    d = d.select("id", "file", F.concat(marked(F.col("lines")), several, whole).alias("units"))
    each = d.select("id", "file", F.posexplode(F.filter("units", lambda u: u["text"].rlike(pattern))).alias("unit", "u"))
    return _counted(each.select("id", "file", "unit", F.col("u.edge").alias("edge"), F.sort_array(_terms(F.col("u.text"))).alias("terms")))


def _counted(units: DataFrame) -> DataFrame:
    """Sorted terms as an array of (term, tf). Counted inside the row: a shuffle by unit and term would move every term."""
    starts = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    units = units.withColumn("starts", F.when(F.size("terms") > 0, starts).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("terms")))
    pairs = F.zip_with("starts", F.slice(ends, F.lit(1), F.size("starts")), lambda a, b: F.struct(F.get("terms", a).alias("term"), (b - a).alias("tf")))
    return units.select("id", "file", "unit", "edge", pairs.alias("terms"))


class Model(NamedTuple):
    """What units are compared with: template vectors, idf of their terms and of any other, the anchors' pattern."""

    templates: Sequence[Template]
    vectors: list[Counter[str]]
    idf: dict[str, float]
    other: float
    pattern: str
    least: float


def fit(df: DataFrame, least: float = 0.7, templates: Sequence[Template] = TEMPLATES, text_col: str = "text") -> Model:
    """The model of all files of df."""
    vectors = [terms(t.text) for t in templates]
    _, idf, other = weights(df, text_col, sorted(set().union(*vectors)))
    return Model(templates, vectors, idf, other, _any_of(anchors(vectors, [set(t.must.split()) for t in templates], idf, least)), least)


def score(df: DataFrame, least: float = 0.7, templates: Sequence[Template] = TEMPLATES, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """id, own_license, own_score, at_edge of the files with a unit of cosine `least` or more; score to six places. Rows
    that share an id are files of their own."""
    return _scored(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fit(df, least, templates, text_col))


def _scored(files: DataFrame, model: Model) -> DataFrame:
    """`score` of files (id, text)."""
    spark = files.sparkSession
    templates, vectors, idf, other, pattern, least = model
    d = files.select("id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("text").rlike(pattern))
    units = stored(_units(d.withColumn("file", F.monotonically_increasing_id()), pattern), "units")
    rows = ", ".join(f"('{t}', {idf[t]!r}D)" for t in sorted(idf))
    term_table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(term, idf)")
    length = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in own.items())) for own in vectors]
    rows = ", ".join(f"({k}, '{t}', {n * idf[t] ** 2 / length[k]!r}D, {int(t in templates[k].must.split())})" for k, own in enumerate(vectors) for t, n in sorted(own.items()))
    template_table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, term, part, must)")
    rows = ", ".join(f"({k}, '{t.license}', {length[k]!r}D, {len(set(t.must.split()))}, {str(t.license == RESERVATION).lower()})" for k, t in enumerate(templates))
    names = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, name, size, musts, bare)")
    # The rows of a unit stay in its task until they are summed there, so one row for each unit and template is moved.
    sparse = units.select("id", "file", "unit", "edge", F.explode("terms").alias("x")).select("id", "file", "unit", "edge", "x.term", "x.tf")
    norm = sparse.join(F.broadcast(term_table), "term", "left").groupBy("file", "unit").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(other)), F.lit(2.0)))).alias("norm"))
    dots = sparse.join(F.broadcast(template_table), "term").groupBy("id", "file", "unit", "edge", "template").agg(F.sum(F.col("tf") * F.col("part")).alias("dot"), F.sum("must").alias("found"))
    dots = dots.join(F.broadcast(names), "template").filter("found = musts")
    cosines = dots.join(norm, ["file", "unit"]).select("id", "file", "edge", "name", "size", "bare", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= least)
    evidence = F.round(-F.col("score") * F.col("score") * F.col("size"), 4)
    best = cosines.groupBy("file").agg(F.first("id").alias("id"), F.min(F.struct("bare", evidence.alias("e"), "name", (-F.col("score")).alias("s"), (~F.col("edge")).alias("inside"))).alias("m"))
    return best.select("id", F.col("m.name").alias("own_license"), (-F.col("m.s")).alias("own_score"), (~F.col("m.inside")).alias("at_edge"))


def _folder(path: str) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def folder_licenses(files: DataFrame) -> DataFrame:
    """of, ancestor, given: for each folder of files (path, own_license, is_licence) the nearest folder above it, itself
    first, that has a licence file, and that file's licence."""
    f = files.select("path", "own_license", "is_licence", _folder("path").alias("folder")).filter("folder IS NOT NULL")
    given = f.filter("is_licence AND own_license IS NOT NULL").groupBy("folder").agg(F.min(F.struct("path", "own_license"))["own_license"].alias("given"))
    steps = F.split("folder", "/")
    levels = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    chains = f.select("folder").distinct().select("folder", F.posexplode(F.array_distinct(levels)).alias("depth", "ancestor"))
    nearest = chains.join(given.withColumnRenamed("folder", "ancestor"), "ancestor").groupBy("folder").agg(F.max(F.struct("depth", "ancestor", "given")).alias("m"))
    return nearest.select(F.col("folder").alias("of"), F.col("m.ancestor").alias("ancestor"), F.col("m.given").alias("given"))


def inherit(files: DataFrame) -> DataFrame:
    """The columns of files (path, own_license, is_licence, ...), license and inherited_from for each of its rows.

    `inherited_from` is the folder, null for a licence of the file's own or none. The top folder is the empty string."""
    out = files.join(folder_licenses(files), _folder("path") == F.col("of"), "left")
    return out.select(*files.columns, F.coalesce("own_license", "given").alias("license"), F.when(F.col("own_license").isNull(), F.col("ancestor")).alias("inherited_from"))


def document_path(id_col: str = "doc_id", source_col: str = "source") -> Column:
    """A path for tables that have none: the source, a folder for each digit of the number but the last, the number."""
    stem = F.regexp_replace(F.expr(f"`{id_col}` DIV 10").cast("string"), "(.)", "$1/")
    return F.concat(F.coalesce(F.col(source_col), F.lit("")), F.lit("/"), stem, F.col(id_col).cast("string"))


def scan(df: DataFrame, least: float = 0.7, templates: Sequence[Template] = TEMPLATES, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, path, own_license, own_score, license, inherited_from for each row of df. With `path`, files named like
    one are a folder's licence files; without, files that open or end with a licence are."""
    model = fit(df, least, templates, text_col)
    # Rows get a stored key; only texts with an anchor are kept beside it.
    text = F.when(F.col(text_col).rlike(model.pattern), F.col(text_col))
    base = stored(df.select(F.col(id_col).alias("doc_id"), (document_path() if path is None else path).alias("path"), text.alias("text"), F.monotonically_increasing_id().alias("row")), "files")
    found = stored(_scored(base.filter("text IS NOT NULL").select(F.col("row").alias("id"), "text"), model), "licenses").withColumnRenamed("id", "row")
    files = base.select("row", "doc_id", "path").join(found, "row", "left")
    is_licence = F.coalesce("at_edge", F.lit(False)) if path is None else F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    return inherit(files.select("doc_id", "path", "own_license", "own_score", is_licence.alias("is_licence"))).select("doc_id", "path", "own_license", "own_score", "license", "inherited_from")
