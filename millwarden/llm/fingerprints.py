"""Document fingerprints: a Merkle tree over the sections and paragraphs of a text.

Leaves are sentences (at most LEAF code points; together they are the whole text, byte for byte), a paragraph ends with a line
feed, a section with an empty line or after a paragraph whose last digest ends in 0 (one in sixteen, chosen by content, so an
insertion moves no border but its own).  A leaf's token is its digest, its length and a letter for what it ends; a paragraph's
digest is that of its tokens, a section's that of its paragraphs, the root that of the sections.  Equal roots are equal texts.
Two trees are compared from the root down: sections that both have are left alone, the leaves of the others are told apart.
Their likeness is Dice's over distinct leaves weighed by code points; it is 1 for equal roots alone.

The following text of each text is found in one shuffle of the texts: keys are cut at sketched quantiles (at most CUTS, whatever
the corpus), a hot key is cut further by the hash of its texts, and the first row of each bucket also goes to the bucket before it.

Defined results: a null text is an empty one; rows are followed in descending order of key, nulls last, rows of one key in order
of the hash of the text, the last one by the first; repeated rows follow one another, a row alone follows itself; an empty
table gives no rows; other columns are not read.  A table of one key and one text repeated is one bucket, which Spark spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millwarden.llm.common import bind

LEAF = 48
#: Rows of a bucket, and the most cut points (16 bytes each) that go to the driver and into the plan.
ROWS, CUTS = 2000, 10_000

#: In RE2 and Java alike: a sentence, marks alone, empty lines alone.
_LEAF = f"[^.!?\\n]{{1,{LEAF}}}(?:[.!?]+ *)?\\n*|[.!?]+ *\\n*|\\n+"
_SECTION, _PARAGRAPH, _TOKEN = "[^s]*s|[^s]+", "[^sp]*[sp]|[^sp]+", "[^spl]*[spl]"
_DIGEST = 32


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _token(leaf: Column) -> Column:
    def with_flag(digest: Column) -> Column:
        section = leaf.endswith("\n\n") | (leaf.endswith("\n") & digest.endswith("0"))
        flag = F.when(section, "s").when(leaf.endswith("\n"), "p").otherwise("l")
        return F.concat(digest, F.char_length(leaf).cast("string"), flag)

    return bind(F.substring(F.sha2(leaf, 256), 1, _DIGEST), with_flag)


def _chars(tokens: Column) -> Column:
    """Code points under the tokens."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda n, t: n + _token_chars(t))


def _token_chars(token: Column) -> Column:
    return token.substr(F.lit(_DIGEST + 1), F.char_length(token) - (_DIGEST + 1)).cast("long")


def _section_digest(section: Column) -> Column:
    return F.sha2(F.array_join(F.transform(_all(section, _PARAGRAPH), lambda p: F.sha2(p, 256)), ""), 256)


def tree(text: Column) -> Column:
    """Struct of ``root``, ``sections`` (the tokens under each, in one string), ``leaves`` (tokens) and ``weight`` (code points of distinct leaves)."""
    def whole(leaves: Column) -> Column:
        def with_root(sections: Column) -> Column:
            root = F.sha2(F.array_join(F.transform(sections, _section_digest), ""), 256)
            return F.struct(root.alias("root"), sections.alias("sections"), leaves.alias("leaves"), _chars(F.array_distinct(leaves)).alias("weight"))

        return bind(_all(F.array_join(leaves, ""), _SECTION), with_root)

    return bind(F.transform(_all(F.coalesce(text.cast("string"), F.lit("")), _LEAF), _token), whole)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two trees; 1 for equal roots alone."""
    def only(x: Column, y: Column) -> Column:
        under = _all(F.array_join(F.array_except(x["sections"], y["sections"]), ""), _TOKEN)
        return _chars(F.array_except(under, y["leaves"]))

    both = a["weight"] + b["weight"]
    unlike = F.greatest(only(a, b) + only(b, a), F.lit(1)) / F.greatest(both, F.lit(1))
    return F.when(a["root"] == b["root"], 1.0).otherwise(F.greatest(1 - unlike, F.lit(0.0)))


def _cut_points(keyed: DataFrame, rows: int, cuts: int) -> tuple[list[int], list[int], int]:
    """Sorted cut points; per bucket (keys from a cut point up to the next) its parts; parts of the null keys."""
    total, known = keyed.agg(F.count("*"), F.count("key")).first()
    parts = lambda n: max(1, min(cuts, -(-n // rows)))
    n = parts(known)
    marks = []
    if n > 1:
        marks = keyed.agg(F.percentile_approx("key", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0]
    times = {m: marks.count(m) for m in set(marks)} if len(set(marks)) < len(marks) else {}
    hot = {m: k + 1 for m, k in times.items() if k > 1}
    points = sorted({*marks, *(m + 1 for m in hot)})
    return points, [1] + [hot.get(p, 1) for p in points], parts(total - known)


def _bucketed(keyed: DataFrame, points: list[int], parts: list[int], null_parts: int) -> DataFrame:
    """Adds ``bucket`` (-1 for null keys), ``part`` of it by the hash, and ``parts``, the number of these; more than one if all its keys are one."""
    width = max(1, int(len(points) ** 0.5))
    rows = [points[k : k + width] for k in range(0, len(points), width)]
    key = F.col("key")

    def up_to(values: Column) -> Column:
        return F.size(F.filter(values, lambda p: p <= key))

    bucket = F.lit(0)
    if points:
        firsts = F.lit([r[0] for r in rows]).cast("array<long>")
        inner = F.lit([r + [None] * (width - len(r)) for r in rows]).cast("array<array<long>>")
        bucket = bind(up_to(firsts), lambda g: F.when(g == 0, 0).otherwise((g - 1) * width + up_to(F.get(inner, g - 1))))
    placed = keyed.withColumn("bucket", F.when(key.isNull(), -1).otherwise(bucket).cast("int"))
    placed = placed.withColumn("parts", F.when(F.col("bucket") < 0, null_parts).otherwise(F.get(F.lit(parts), F.col("bucket"))))
    part = F.least(F.floor((F.col("hash") / 2.0**64 + 0.5) * F.col("parts")).cast("int"), F.col("parts") - 1)
    return placed.withColumn("part", F.when(F.col("parts") > 1, part).otherwise(0))


def followed(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS, cuts: int = CUTS) -> DataFrame:
    """Per row ``key``, ``text``, ``tree`` and ``next``: the text and the tree of the row after it in descending order of key."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.col(key).cast("long").alias("key"), body.alias("text")).withColumn("hash", F.xxhash64("text"))
    placed = _bucketed(keyed, *_cut_points(keyed, rows, cuts))
    # One row per bucket and part: a bounded table, in the order of the rows.
    firsts = placed.groupBy("bucket", "part").agg(F.max("key").alias("first_key"), F.min(F.when(F.col("parts") > 1, F.col("hash"))).alias("first_hash"))
    order = Window.orderBy(F.desc("bucket"), "part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag(F.struct("bucket", "part")).over(Window.orderBy(F.desc("bucket"), "part")), F.last(F.struct("bucket", "part")).over(order))
    firsts = firsts.select("bucket", "part", "first_key", "first_hash", before.alias("before"))
    opens = F.col("key").eqNullSafe(F.col("first_key")) & ((F.col("parts") == 1) | (F.col("hash") == F.col("first_hash")))
    here = F.struct(F.col("bucket"), F.col("part"), F.lit(False).alias("again"))
    there = F.struct(F.col("before.bucket"), F.col("before.part"), F.lit(True).alias("again"))
    dealt = placed.join(F.broadcast(firsts), ["bucket", "part"])
    dealt = dealt.select("key", "hash", "text", F.explode(F.when(opens, F.array(here, there)).otherwise(F.array(here))).alias("at"))
    dealt = dealt.select("key", "hash", "text", "at.*").repartition("bucket", "part").withColumn("tree", tree(F.col("text")))
    inside = Window.partitionBy("bucket", "part").orderBy("again", F.desc_nulls_last("key"), "hash")
    return dealt.withColumn("next", F.lead(F.struct("text", "tree")).over(inside)).filter("NOT again").select("key", "text", "tree", "next")


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS, cuts: int = CUTS) -> DataFrame:
    """Per row: key, ``n_chars``, ``fingerprint``; and the same of the edited text, whose last third is replaced by the opening of the next row's.

    ``near_edited`` and ``near_next`` are the likenesses to the edited and to the next text.
    """
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third))
    done = followed(docs, key, text, rows, cuts).select("key", n.cast("long").alias("n_chars"), "tree", F.col("next.tree").alias("next_tree"), edited.alias("edited"))
    done = done.withColumn("edited_tree", tree(F.col("edited")))
    return done.select(F.col("key").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("tree.root").alias("fingerprint"), F.col("edited_tree.root").alias("edited_fingerprint"),
                       likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"), likeness(F.col("tree"), F.col("next_tree")).alias("near_next"))


def _sections(trees: DataFrame, side: str) -> DataFrame:
    """A row per section: key, its number, the code points before it, its tokens."""
    cut = trees.select("key", F.posexplode("tree.sections").alias("section", "tokens"))
    before = F.sum(_chars(_all(F.col("tokens"), _TOKEN))).over(Window.partitionBy("key").orderBy("section").rowsBetween(Window.unboundedPreceding, -1))
    return cut.select("key", "section", F.coalesce(before, F.lit(0)).alias("start"), "tokens", F.lit(side).alias("side"))


def _leaves(sections: DataFrame) -> DataFrame:
    cut = sections.select("key", "side", "section", "start", F.posexplode(_all(F.col("tokens"), _TOKEN)).alias("leaf", "token")).withColumn("n_chars", _token_chars(F.col("token")))
    before = F.sum("n_chars").over(Window.partitionBy("key", "section").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("start", F.col("start") + F.coalesce(before, F.lit(0)))


def locate_edits(old: DataFrame, new: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Leaves of either version that the other lacks, by descending the branches that differ: key, side, section, start, n_chars (code points).

    Keys are unique in each version and not null; a key of one version alone is compared with an empty text.
    """
    versions = [d.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), tree(F.col(text)).alias("tree")) for d in (old, new)]
    roots = [v.select("key", F.col("tree.root").alias("root")) for v in versions]
    changed = [versions[k].join(roots[1 - k], [versions[k]["key"] == roots[1 - k]["key"], versions[k]["tree.root"] == roots[1 - k]["root"]], "left_anti") for k in (0, 1)]
    sections = [_sections(c, side) for c, side in zip(changed, ("old", "new"))]
    differing = [sections[k].join(sections[1 - k].select("key", "tokens").distinct(), ["key", "tokens"], "left_anti") for k in (0, 1)]
    every = [_leaves(s).select("key", "token").distinct() for s in sections]
    found = [_leaves(differing[k]).join(every[1 - k], ["key", "token"], "left_anti") for k in (0, 1)]
    return found[0].unionByName(found[1]).select(F.col("key").alias(key), "side", "section", "start", "n_chars")


def oracle() -> str:
    """DuckDB SQL for the rows of ``fingerprint`` over ``documents``."""
    def all_of(text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, '{pattern}')"

    token = ("list_transform(leaves, lambda x: substr(sha256(x), 1, 32) || length(x) || CASE WHEN suffix(x, chr(10) || chr(10)) OR (suffix(x, chr(10)) AND substr(sha256(x), 32, 1) = '0') "
             "THEN 's' WHEN suffix(x, chr(10)) THEN 'p' ELSE 'l' END)")
    section = f"sha256(array_to_string(list_transform({all_of('s', _PARAGRAPH)}, lambda p: sha256(p)), ''))"
    chars = "CAST(coalesce(list_sum(list_transform({}, lambda x: CAST(substr(x, 33, length(x) - 33) AS BIGINT))), 0) AS BIGINT)"
    only = chars.format("list_distinct(list_filter(a.tokens, lambda x: NOT list_contains(b.tokens, x)))")

    def near(a: str, b: str) -> str:
        ab, ba = (only.replace("a.", f"{x}.").replace("b.", f"{y}.") for x, y in ((a, b), (b, a)))
        return (f"CASE WHEN {a}.root = {b}.root THEN 1.0::DOUBLE ELSE greatest(1 - greatest({ab} + {ba}, 1) / greatest({a}.weight + {b}.weight, 1), 0.0::DOUBLE) END")

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
l AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM d),
e AS (SELECT *, left(text, n - n // 3) || left(next, n // 3) AS edited FROM l),
u AS (SELECT DISTINCT text FROM (SELECT text FROM e UNION ALL SELECT edited FROM e)),
v AS (SELECT text, {all_of('text', _LEAF)} AS leaves FROM u),
t AS (SELECT text, {token} AS tokens FROM v),
trees AS (SELECT text, tokens, sha256(array_to_string(list_transform({all_of("array_to_string(tokens, '')", _SECTION)}, lambda s: {section}), '')) AS root,
  {chars.format('list_distinct(tokens)')} AS weight FROM t)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, o.root AS fingerprint, f.root AS edited_fingerprint, {near('o', 'f')} AS near_edited, {near('o', 'g')} AS near_next
FROM e JOIN trees o ON o.text = e.text JOIN trees f ON f.text = e.edited JOIN trees g ON g.text = e.next"""
