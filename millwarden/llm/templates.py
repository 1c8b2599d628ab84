"""Benchmark decontamination by template windows.

Names (capitalised words, wherever they stand), numbers and units after numbers become typed slots; the rest is lower-cased words.
Windows of WINDOW template words of the benchmark items are hash-joined to those of the texts, once with names as slots and once
with names as plain words: so neither what stands before a copy nor its letter case matters, nor do other names.  Matches of an
item and a text at one offset are put together; where they cover LEAST words, or the whole of a shorter item, the slots are
compared: a value of the item must stand for one value in the text throughout.  So a question with other numbers or names is
found, a chance match of frames is not.

Windows of the benchmark need LITERAL words that are no slots.  The windows of an item shorter than WINDOW are the item itself.
Texts are told apart by their md5; all rows of a text share its verdict.

Defined results: null and empty texts and items match nothing; an item under LITERAL words can match nothing; repeated rows of the
benchmark count once; empty tables give no rows.  ``decontaminate`` carries all columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millwarden.llm.common import bind, fresh_name
from millwarden.session import cut_lineage

WINDOW, LITERAL, LEAST = 8, 4, 13
#: Rows of benchmark windows, and of matches, up to which they are broadcast.
BROADCAST_ROWS = 500_000

#: Marks of the slots, and the units that are known.
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
UNITS = ("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s ms min h hr hrs day days week weeks month months year years hour hours minute minutes second seconds "
         "mph kmh hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar k c f percent usd eur gbp dollars dollar euros euro pounds cents kb mb gb tb meters "
         "metres kilometers kilometres miles feet inches kilograms grams liters litres degrees").split()
_NAMED = r"(^|[^\p{L}])(\p{Lu}\p{L}*)"
#: Copies of a side that is joined to a hot one, beyond what is broadcast.
SALTS = 16


def valued(text: Column) -> Column:
    """Words of a text, a slot as its mark and its value."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    out = F.regexp_replace(out, "[\ue001-\ue003]", " ")
    out = F.regexp_replace(out, _NAMED, f"$1{NAME}$2")
    out = F.regexp_replace(F.lower(out), "([0-9]+)", f" {NUMBER}$1 ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}" + "\ue001-\ue003]+", " ")
    out = F.regexp_replace(out, f"({NUMBER}[0-9]+) {NAME}?({'|'.join(UNITS)})( |$)", f"$1 {UNIT}$2$3")
    trimmed = F.trim(out)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def framed(word: Column, names: bool) -> Column:
    """A word, a slot without its value; a name is a slot only if ``names``."""
    mark = word.substr(1, 1)
    slots = [NAME, NUMBER, UNIT] if names else [NUMBER, UNIT]
    out = F.when(mark.isin(*slots), mark)
    return (out if names else out.when(mark == NAME, F.substring(word, 2, 1 << 30))).otherwise(word)


def template(words: Column, names: bool = True) -> Column:
    """The words with slots emptied of their values."""
    return F.transform(words, lambda w: framed(w, names))


def _beside(hashes: Column, step: int) -> Column:
    """Hash of each entry and the one ``step`` further, where there is one."""
    count = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.slice(F.zip_with(hashes, F.slice(hashes, step + 1, count), lambda a, b: F.xxhash64(a, b)), 1, count)


def _hashes(words: Column, n: int, names: bool) -> Column:
    """Hash of each window of ``n`` words, by its place: of halves, of halves of these, and of single words where n is odd."""
    def of(h: Column, n: int, then) -> Column:
        if n == 1:
            return then(h)
        if n % 2 == 0:
            return of(h, n // 2, lambda half: bind(half, lambda x: then(_beside(x, n // 2))))
        count = F.greatest(F.size(h) - (n - 1), F.lit(0))
        return of(h, n - 1, lambda most: then(F.slice(F.zip_with(most, F.slice(h, n, count), lambda a, b: F.xxhash64(a, b)), 1, count)))

    single = F.transform(words, lambda w: F.xxhash64(framed(w, names)))
    return bind(single, lambda h: of(h, n, lambda x: x))


def _windows(words: Column, sizes: list[int]) -> Column:
    """The number of words, and the hashes of all windows of the sizes, with names as slots and as words, end to end."""
    return F.struct(F.size(words).alias("count"), F.concat(*(_hashes(words, n, names) for n in sizes for names in (True, False))).alias("hashes"))


def _place(position: Column, count: Column, sizes: list[int]) -> Column:
    """The place in the text of the window at ``position`` among those of ``_windows``."""
    out, rest = position, position
    for n in sizes:
        for _ in (True, False):
            length = F.greatest(count - (n - 1), F.lit(0))
            out = F.when(rest < 0, out).otherwise(rest)
            rest = rest - length
    return out


def _joined(rows: DataFrame, few: DataFrame, on: str, small: bool, by: str) -> DataFrame:
    """Join with a broadcast table, or one whose rows are copied so that a hot value's rows, dealt by ``by``, go to many tasks."""
    if small:
        return rows.join(F.broadcast(few), on)
    copied = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copied, [on, "_salt"]).drop("_salt")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(text_hash, item, words covered, slots, exact) of each text and benchmark item that it gives away."""
    items = benchmark.select(F.col(item).alias("item"), valued(F.col(item_text)).alias("item_words")).filter(F.size("item_words") >= LITERAL).distinct()
    items = cut_lineage(items)
    sizes = sorted(r[0] for r in items.select(F.least(F.size("item_words"), F.lit(WINDOW))).distinct().collect()) or [WINDOW]
    own = [items.filter(F.size("item_words") == n) if n < WINDOW else items.filter(F.size("item_words") >= n) for n in sizes]
    known = None
    for n, some in zip(sizes, own):
        for names in (True, False):
            hashed = F.posexplode(_hashes(F.col("item_words"), n, names)).alias("item_place", "hash")
            at = some.select("item", template(F.col("item_words"), names).alias("frame"), hashed)
            literal = F.size(F.filter(F.slice("frame", F.col("item_place") + 1, n), lambda w: ~w.isin(NAME, NUMBER, UNIT)))
            at = at.filter(literal >= LITERAL).select("item", "item_place", "hash", F.lit(n).alias("size"))
            known = at if known is None else known.union(at)
    known = cut_lineage(known.distinct())
    known_small = known.count() <= BROADCAST_ROWS

    hashed = docs.select(F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    placed = hashed.select(F.md5("text").alias("text_hash"), bind(valued(F.col("text")), lambda words: _windows(words, sizes)).alias("w"))
    placed = placed.select("text_hash", "w.count", F.posexplode("w.hashes").alias("position", "hash"))
    met = _joined(placed, known, "hash", known_small, "text_hash")
    place = _place(F.col("position"), F.col("count"), sizes)
    met = met.select("text_hash", "item", "item_place", "size", (place - F.col("item_place")).alias("offset")).groupBy("text_hash", "item", "offset").agg(
        F.sort_array(F.collect_set(F.struct("item_place", "size"))).alias("places"))
    # An item has few places, whatever the corpus; windows overlap, so a place counts up to the next one.
    spans = F.transform("places", lambda p, k: F.least(p["size"], F.coalesce(F.get(F.col("places"), k + 1)["item_place"] - p["item_place"], p["size"])))
    met = met.select("text_hash", "item", "offset", F.aggregate(spans, F.lit(0), lambda a, n: a + n).alias("covered"),
                     F.get("places", F.lit(0))["item_place"].alias("low"), F.expr("places[size(places) - 1].item_place + places[size(places) - 1].size - 1").alias("high"))
    met = cut_lineage(met.join(items, "item").filter(F.col("covered") >= F.least(F.lit(LEAST), F.size("item_words"))))
    met_small = met.count() <= BROADCAST_ROWS // 10

    keys = met.select("text_hash").distinct()
    again = hashed.withColumn("text_hash", F.md5("text")).join(F.broadcast(keys) if met_small else keys, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    both = again.select("text_hash", valued(F.col("text")).alias("words")).join(met, "text_hash")
    pairs = F.transform(F.sequence("low", "high"), lambda k: F.struct(F.get(F.col("item_words"), k).alias("a"), F.get(F.col("words"), k + F.col("offset")).alias("b")))
    slots = F.filter(pairs, lambda p: p["a"].substr(1, 1).isin(NAME, NUMBER, UNIT) & (p["a"].substr(1, 1) == p["b"].substr(1, 1)))
    both = both.select("text_hash", "item", "covered", F.array_distinct(slots).alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda p: p["a"])))
    exact = F.forall("slots", lambda p: p["a"] == p["b"])
    found = both.filter(consistent).select("text_hash", "item", F.struct("covered", exact.alias("exact"), F.size("slots").alias("slots")).alias("best"))
    return found.groupBy("text_hash", "item").agg(F.max("best").alias("best")).select(
        "text_hash", F.col("item").alias(item), F.col("best.covered").alias("covered"), F.col("best.slots").alias("slots"), F.col("best.exact").alias("exact"))


def leaking_rows(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item, covered, slots, exact) per row of ``docs`` and item that its text gives away."""
    found = cut_lineage(leaks(docs, benchmark, text, item))
    rows = docs.select(F.col(key), F.md5(F.col(text).cast("string")).alias("text_hash"))
    return _joined(rows, found, "text_hash", found.count() <= BROADCAST_ROWS, key).drop("text_hash")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with its columns, whose texts give no item away."""
    found = cut_lineage(leaks(docs, benchmark, text).select("text_hash").distinct())
    name = fresh_name(docs, "text_hash")
    found = found.withColumnRenamed("text_hash", name)
    small = found.count() <= BROADCAST_ROWS
    return docs.withColumn(name, F.md5(F.col(text).cast("string"))).join(F.broadcast(found) if small else found, name, "left_anti").drop(name)


def oracle() -> str:
    """DuckDB SQL over ``documents`` and ``benchmark``."""
    def words(text: str) -> str:
        out = f"regexp_replace(coalesce({text}, ''), '[{NAME}-{UNIT}]', ' ', 'g')"
        out = f"regexp_replace({out}, '{_NAMED}', '\\1{NAME}\\2', 'g')"
        out = f"regexp_replace(lower({out}), '([0-9]+)', ' {NUMBER}\\1 ', 'g')"
        out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}{NAME}-{UNIT}]+', ' ', 'g')"
        out = f"regexp_replace({out}, '({NUMBER}[0-9]+) {NAME}?({'|'.join(UNITS)})( |$)', '\\1 {UNIT}\\2\\3', 'g')"
        return f"list_filter(string_split(trim({out}), ' '), lambda x: x <> '')"

    slot = f"('{NAME}', '{NUMBER}', '{UNIT}')"
    frame = f"lambda x: CASE WHEN x[1] IN {slot} THEN x[1] ELSE x END"
    plain = f"lambda x: CASE WHEN x[1] = '{NAME}' THEN x[2:] WHEN x[1] IN {slot} THEN x[1] ELSE x END"
    both = f"unnest([list_transform({{w}}, {frame}), list_transform({{w}}, {plain})])"
    return f"""
WITH items AS (SELECT DISTINCT item_id, iw FROM (SELECT item_id, {words('text')} AS iw FROM benchmark) WHERE len(iw) >= {LITERAL}),
frames AS (SELECT item_id, {both.format(w='iw')} AS it FROM items),
known AS (SELECT DISTINCT item_id, n, k, win FROM (SELECT item_id, n, k, it[k:k + n - 1] AS win FROM (
  SELECT item_id, it, least(len(it), {WINDOW}) AS n, unnest(range(1, len(it) - least(len(it), {WINDOW}) + 2)) AS k FROM frames))
  WHERE len(list_filter(win, lambda x: x NOT IN {slot})) >= {LITERAL}),
texts AS MATERIALIZED (SELECT h, dw FROM (SELECT md5(text) AS h, {words('text')} AS dw FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL))),
placed AS (SELECT h, n, p, dt[p:p + n - 1] AS win FROM (SELECT h, dt, n, unnest(range(1, len(dt) - n + 2)) AS p FROM (SELECT h, {both.format(w='dw')} AS dt FROM texts), (SELECT DISTINCT n FROM known))),
met AS (SELECT DISTINCT h, item_id, p - k AS d, k, n FROM placed JOIN known USING (n, win)),
spans AS (SELECT *, least(n, coalesce(lead(k) OVER (PARTITION BY h, item_id, d ORDER BY k, n) - k, n)) AS span FROM met),
runs AS (SELECT h, item_id, d, sum(span) AS covered, min(k) AS low, max(k) + max_by(n, k) - 1 AS high FROM spans GROUP BY ALL),
pairs AS (SELECT h, item_id, iw, d, covered, list_distinct(list_filter(list_transform(range(low, high + 1), lambda j: [iw[j], dw[j + d]]),
  lambda q: q[1][1] IN {slot} AND q[1][1] = q[2][1])) AS slots FROM runs JOIN items USING (item_id) JOIN texts USING (h) WHERE covered >= least({LEAST}, len(iw))),
best AS (SELECT h, item_id, max(struct_pack(covered := CAST(covered AS INTEGER), exact := len(list_filter(slots, lambda q: q[1] <> q[2])) = 0, slots := CAST(len(slots) AS INTEGER))) AS b
  FROM pairs WHERE len(slots) = len(list_distinct(list_transform(slots, lambda q: q[1]))) GROUP BY ALL)
SELECT doc_id, item_id, b.covered AS covered, b.slots AS slots, b.exact AS exact FROM documents JOIN best ON md5(text) = h"""
