"""Secret scans by corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found in every text, their values hashed, and the hashes counted
by distinct owner and repository over the whole corpus.  A value seen under
several owners is a widely copied example; one that a single owner has is a
live-looking credential, unless several of its repositories share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankscope.llm.common import materialize, numbered, text_key

#: Kinds in their order, pattern, the group that holds the value, and its least length.
KINDS = [
    ("assign", "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
               "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
     1, 6),
    ("access", "(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", "([0-9a-f]+)", 1, 24),
]
#: The kind that ownership adds: long words that mix capitals, small letters and digits.
ADDED = ("owned", "([A-Za-z0-9+/_-]+)", 1, 24)
#: A value that this many owners have is an example; one that a single owner keeps in this many repositories is its
#: own boilerplate, shared among them.
EXAMPLE_OWNERS, SHARED_REPOS = 3, 3


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Array of (kind, n, before, whole, value): n-th match, length of the text since the match before, match, value."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    return F.when(text.rlike(pattern), F.transform(
        F.arrays_zip(whole.alias("whole"), value.alias("value"), between.alias("between")),
        lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), F.length(m["between"]).alias("before"),
                              F.length(m["whole"]).alias("whole"), m["value"].alias("value"))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
               repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per candidate: id, key, owner, repo, copies, kind, start, end, value_start, digest.

    Offsets are code points, end exclusive.  A document without a candidate
    has one row with a null kind.  Rows equal in id, text, owner and
    repository are one document with ``copies`` rows.
    """
    repo = F.to_json(F.array(*[F.col(c).cast("string") for c in repo_cols]))
    d = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"),
                    F.col(owner_col).cast("string").alias("owner"), repo.alias("repo"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    least = {kind: n for kind, _, _, n in [*KINDS, ADDED]}
    # Matches of these two are whole runs of one class, so shorter runs need not be found first and dropped.
    runs = {"hex": "([0-9a-f]{24,})", "owned": "([A-Za-z0-9+/_-]{24,})"}
    found = [F.coalesce(_matches(t, kind, runs.get(kind, pattern), group), F.array())
             for kind, pattern, group, _ in [*KINDS, ADDED]]
    d = d.select("id", "key", "owner", "repo", F.concat(*found).alias("m"))
    d = d.select("id", "key", "owner", "repo", F.explode_outer("m").alias("m"))
    d = d.select("id", "key", "owner", "repo", "m.kind", "m.n", "m.before", "m.whole",
                 F.length("m.value").alias("size"), F.sha2("m.value", 256).alias("digest"),
                 (F.col("m.value").rlike("[A-Z]") & F.col("m.value").rlike("[a-z]")
                  & F.col("m.value").rlike("[0-9]")).alias("mixed"))
    doc = ["id", "key", "owner", "repo"]
    d = materialize(d.groupBy(*doc, "kind", "n", "before", "whole", "size", "digest", "mixed")
                    .agg(F.count(F.lit(1)).alias("copies")))
    so_far = Window.partitionBy(*doc, "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("end", F.sum(F.col("before") + F.col("whole")).over(so_far))
    d = d.withColumn("start", F.col("end") - F.col("whole")).withColumn("value_start", F.col("end") - F.col("size"))
    enough = F.lit(False)
    for kind, n in least.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("size") >= n))
    good = enough & ((F.col("kind") != ADDED[0]) | F.col("mixed"))
    at = F.when(good, F.col("kind"))
    cols = {c: F.when(at.isNotNull(), F.col(c)) for c in ("start", "end", "value_start", "digest")}
    return (d.withColumns(cols).withColumn("kind", at)
            .select(*doc, "copies", "kind", "start", "end", "value_start", "digest").distinct())


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_owners, n_repos, n_spans) of every candidate value; an unknown owner is one owner."""
    owner = F.coalesce(F.concat(F.lit("="), F.col("owner")), F.lit(""))
    once = (found.where("digest is not null").withColumn("owner", owner)
            .groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n")))
    by_owner = once.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"),
                                          F.sum("n").alias("n_spans"))


def judged_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_cols: tuple[str, ...] = ("source", "lang"),
                 example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """The candidates with their ownership counts and ``verdict``: example, shared or live.

    Base kinds always stay.  A span of the added kind stays only if one owner
    alone has its value and no base span of the document overlaps it.  The
    row with a null kind of a document without spans is kept.
    """
    found = materialize(candidates(docs, id_col, text_col, owner_col, repo_cols))
    freq = materialize(ownership(found))
    doc = ["id", "key", "owner", "repo"]
    rows = found.where("kind is not null").join(freq, "digest")
    verdict = (F.when(F.col("n_owners") >= example_owners, "example")
               .when((F.col("n_owners") > 1) | (F.col("n_repos") >= SHARED_REPOS), "shared")
               .when(F.col("n_owners") == 1, "live"))
    rows = rows.withColumn("verdict", verdict)
    # Overlap with a base span: the furthest end of base spans that start before, and the next base start.
    by_doc = Window.partitionBy(*doc)
    base = F.col("kind") != ADDED[0]
    order = by_doc.orderBy(F.col("start").asc_nulls_first(), F.col("kind"))
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    here = F.max(F.when(base, F.col("start"))).over(by_doc.partitionBy(*doc, "start"))
    rows = rows.withColumns({"_reach": reach, "_after": after, "_here": here})
    clear = ((F.coalesce("_reach", F.lit(-1)) <= F.col("start")) & F.col("_here").isNull()
             & (F.coalesce("_after", F.col("end")) >= F.col("end")))
    stays = F.col("kind").isNull() | base | ((F.col("n_owners") == 1) & clear)
    kind = F.when(stays, F.col("kind"))
    cols = {c: F.when(stays, F.col(c)) for c in ("start", "end", "value_start", "digest", "n_owners", "n_repos",
                                                 "verdict")}
    rows = rows.withColumns(cols).withColumn("kind", kind).drop("_reach", "_after", "_here", "n_spans")
    return rows.unionByName(found.where("kind is null"), allowMissingColumns=True)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_cols: tuple[str, ...] = ("source", "lang"),
                 example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per row of ``docs``: id, key, owner, repo and its ``spans``.

    ``spans`` is an array of (start, kind_no, kind, end, value_start, verdict)
    sorted by start, then kind.  Null and empty texts have no spans; repeated
    rows get the same result each; null ids and owners are values like others;
    an empty table gives an empty one.
    """
    rows = judged_spans(docs, id_col, text_col, owner_col, repo_cols, example_owners)
    number = F.lit(None).cast("int")
    for k, kind in enumerate([k for k, *_ in KINDS] + [ADDED[0]]):
        number = F.when(F.col("kind") == kind, k).otherwise(number)
    span = F.when(F.col("kind").isNotNull(), F.struct(
        "start", number.alias("kind_no"), "kind", "end", "value_start", "verdict"))
    out = rows.groupBy("id", "key", "owner", "repo").agg(
        F.max("copies").alias("copies"), F.sort_array(F.collect_set(span)).alias("spans"))
    return (out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .drop("_copy", "copies"))


def mask_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
              repo_cols: tuple[str, ...] = ("source", "lang"), mask: str = "[SECRET]",
              example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs`` (all columns) with every secret value masked that is no widely copied example.

    Overlapping values become one mask.  Rows and their number do not change;
    a null text stays null; other columns pass through, whatever their names.
    """
    names = docs.columns
    docs, (id_col, text_col, owner_col, *repo_cols) = numbered(docs, id_col, text_col, owner_col, *repo_cols)
    rows = judged_spans(docs, id_col, text_col, owner_col, repo_cols, example_owners)
    rows = rows.where("kind is not null and verdict <> 'example'").select("id", "key", "value_start", "end").distinct()
    order = Window.partitionBy("id", "key").orderBy("value_start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(before.isNull() | (F.col("value_start") > before), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy("id", "key", "island").agg(F.min("value_start").alias("a"), F.max("end").alias("b"))
    cuts = materialize(islands.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_cuts"))
                       .select(F.col("id").alias("_id"), F.col("key").alias("_key"), "_cuts"))
    wide = docs.withColumn("_text_key", text_key(text_col))
    wide = wide.join(cuts, wide[id_col].eqNullSafe(cuts["_id"]) & (wide["_text_key"] == cuts["_key"]), "left")
    # Pieces are taken from an array of characters, so the work is linear in the text.
    wide = wide.withColumn("_chars", F.when(F.col("_cuts").isNotNull(), F.split(F.col(text_col), "")))
    c, chars = F.col("_cuts"), F.col("_chars")
    kept = F.transform("_cuts", lambda x, i: F.concat(
        F.array_join(F.slice(chars, F.coalesce(F.get(c, i - 1)["b"], F.lit(0)).cast("int") + 1,
                             (x["a"] - F.coalesce(F.get(c, i - 1)["b"], F.lit(0))).cast("int")), ""), F.lit(mask)))
    end = F.element_at(c, -1)["b"].cast("int")
    tail = F.array_join(F.slice(chars, end + 1, F.size(chars)), "")
    text = F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(kept, ""), tail))
    return wide.withColumn(text_col, text).select(*docs.columns).toDF(*names)
