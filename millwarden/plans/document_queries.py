"""Queries: documents, retrieval, evidence, citations, grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwarden.functions import text as T
from millwarden.operators import documents as D
from millwarden.operators import evidence as V
from millwarden.operators import profiling as P
from millwarden.operators import text_encoder as TE
from millwarden.operators import vector_index as VI
from millwarden.plans.catalog import query
from millwarden.plans.views import view, with_views
from millwarden.session import cut_lineage, scratch_path


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {sql_text(T.STRIP_PATTERN)}, '', 'g')"


def lines(x: str) -> str:
    return f"[{strip('ln')} FOR ln IN string_split_regex({x}, {sql_text(T.LINE_PATTERN)})]"


def header(x: str, name: str) -> str:
    prefix = f"**{name}:**"
    return strip(f"substr([h FOR h IN {lines(x)} IF starts_with(h, '{prefix}')][-1], {len(prefix) + 1})")


def section(x: str, heading: str) -> str:
    return strip(f"substr([s FOR s IN string_split(chr(10) || {x}, chr(10) || '## ') IF starts_with(s, '{heading}' || chr(10))][1], {len(heading) + 2})")


def joined(expression: str) -> str:
    return f"array_to_string({expression}, '|')"


CHUNKS = with_views("corpus") + f""", s AS (SELECT *, unnest(CASE WHEN length(text) <= 1200 THEN [0] ELSE range(CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT) + 1) END) AS i FROM corpus),
p AS (SELECT *, CASE WHEN length(text) <= 1200 THEN text ELSE {strip('substr(text, i * 1000 + 1, 1200)')} END AS chunk FROM s),
chunks AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS chunk_count
 FROM p WHERE length(text) <= 1200 OR chunk <> '')
"""


def chunked(spark, sf):
    return D.chunk_documents(view(spark, sf, "corpus"))


@query("chunk_documents", CHUNKS + "SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5, length(chunk) AS chunk_length FROM chunks")
def chunk_documents(spark, sf):
    return chunked(spark, sf).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("bigint").alias("chunk_length"))


@query("chunk_ids", CHUNKS + "SELECT doc_id, left(sha256(concat(source_path, ':', CAST(chunk_index AS VARCHAR))), 20) AS chunk_id FROM chunks")
def chunk_ids(spark, sf):
    return chunked(spark, sf).select("doc_id", "chunk_id")


@query("chunk_numbering", CHUNKS + "SELECT doc_id, chunk_index, chunk_count FROM chunks")
def chunk_numbering(spark, sf):
    return chunked(spark, sf).select("doc_id", "chunk_index", "chunk_count")


@query("corpus_profile", CHUNKS + """, d AS (SELECT doc_id, document_type, event_type, severity, count(*) AS c FROM chunks GROUP BY ALL)
SELECT 'document_type' AS dimension, document_type AS value, count(*) AS documents, CAST(sum(c) AS BIGINT) AS chunks FROM d GROUP BY document_type
UNION ALL SELECT 'event_type', event_type, count(*), CAST(sum(c) AS BIGINT) FROM d GROUP BY event_type
UNION ALL SELECT 'severity', severity, count(*), CAST(sum(c) AS BIGINT) FROM d GROUP BY severity
UNION ALL SELECT 'all', 'all', count(*), CAST(sum(c) AS BIGINT) FROM d""")
def corpus_profile(spark, sf):
    return P.corpus_profile(chunked(spark, sf), ("document_type", "event_type", "severity"), "doc_id")


@query("extract_metadata", with_views("records") + f""", m AS (SELECT *, contains(source_path, '/safety_procedures/') AS pr FROM records)
SELECT doc_id, CASE WHEN pr THEN 'safety_procedure' ELSE 'synthetic_incident' END AS document_type, CASE WHEN pr THEN 'procedure' ELSE 'incident' END AS evidence_type,
 CASE WHEN pr AND {header('text', 'is_synthetic')} IS NOT NULL THEN lower({header('text', 'is_synthetic')}) = 'true' ELSE TRUE END AS is_synthetic,
 CASE WHEN pr THEN coalesce({header('text', 'Document ID')}, 'unknown') END AS procedure_id,
 """ + ", ".join(f"CASE WHEN NOT pr THEN {header('text', n)} END AS {c}" for c, n in T.INCIDENT_FIELDS.items()) + " FROM m")
def extract_metadata(spark, sf):
    return D.extract_metadata(view(spark, sf, "records")).drop("text", "source_path")


def _items(heading: str) -> str:
    return joined(f"[{strip('substr(b, 3)')} FOR b IN {lines(section('text', heading))} IF starts_with(b, '- ')]")


def _cell(name: str) -> str:
    return f"TRY_CAST({strip(f'''string_split([r FOR r IN {lines(section('text', 'Sensor Context'))} IF starts_with(r, '| {name} |')][1], '|')[3]''')} AS DOUBLE)"


@query("parse_incidents", with_views("records") + f"""SELECT doc_id, {strip(f"substr([h FOR h IN {lines('text')} IF starts_with(h, '# ')][1], 3)")} AS title,
 """ + ", ".join(f"{header('text', n)} AS {c}" for c, n in T.INCIDENT_FIELDS.items()) + f", md5({section('text', 'Incident Summary')}) AS summary_md5, "
       + ", ".join(f"{_cell(n)} AS {c}" for c, n in D.SENSOR_ROWS.items()) + ", " + ", ".join(f"coalesce({_items(n)}, '') AS {c}" for c, n in D.LIST_SECTIONS.items())
       + " FROM records WHERE contains(source_path, '/synthetic_incidents/')")
def parse_incidents(spark, sf):
    incidents = view(spark, sf, "records").filter(F.contains("source_path", F.lit("/synthetic_incidents/")))
    parsed = D.parse_incidents(incidents, keep=["doc_id"])
    return parsed.select("doc_id", "title", *T.INCIDENT_FIELDS, F.md5("summary").alias("summary_md5"), *D.SENSOR_ROWS,
                         *[F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in D.LIST_SECTIONS])


WEIGHTS = with_views("corpus") + """,
words AS (SELECT doc_id, unnest([w FOR w IN regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') IF w <> '']) AS word FROM corpus),
tf AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(word), 1, 8) AS UBIGINT) % 16384 AS INT) AS feature, count(*) AS n FROM words GROUP BY ALL),
idf AS (SELECT feature, ln((1.0::DOUBLE + (SELECT count(*) FROM corpus)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS w FROM tf GROUP BY feature),
weighed AS (SELECT doc_id, feature, n * w AS x FROM tf JOIN idf USING (feature)),
weights AS (SELECT doc_id, feature, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM weighed)
"""


@query("text_weights", WEIGHTS + "SELECT doc_id, feature, round(weight, 6) AS weight FROM weights")
def text_weights(spark, sf):
    """What the saved document-frequency table makes of every text."""
    docs = view(spark, sf, "corpus").select("doc_id", "text")
    counts, total = TE.document_frequencies(docs.select(TE.word_features("text").alias("ids")), TE.FEATURES)
    return TE.text_weights(docs, TE.inverse_frequency(counts, total), "doc_id").withColumn("weight", F.round("weight", 6))


@query("text_vectors", WEIGHTS + "SELECT doc_id, CAST(384 AS INT) AS size, CASE WHEN doc_id IN (SELECT doc_id FROM weights) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM corpus")
def text_vectors(spark, sf):
    vectors = saved_encoder(spark, view(spark, sf, "corpus")).encode(view(spark, sf, "corpus").select("doc_id", "text"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.select("doc_id", F.size("embedding").alias("size"), F.round(norm, 4).alias("norm"))


def saved_encoder(spark, docs, text="text"):
    path = scratch_path(spark, "encoder")
    TE.fit_encoder(docs, text).save(spark, path)
    return TE.TextEncoder.load(spark, path)


def knowledge_base(spark, sf):
    """Chunks of the corpus, their saved encoder and their stored index."""
    chunks = cut_lineage(chunked(spark, sf).select("chunk_id", "doc_id", "chunk_index", "chunk", "source_path", "document_type", "evidence_type", "event_type", "severity", "is_synthetic"))
    encoder = saved_encoder(spark, chunks, "chunk")
    return chunks, encoder, VI.build_index(encoder.encode(chunks, "chunk"), scratch_path(spark, "knowledge"), "chunk_id")


@query("ask_corpus")
def ask_corpus(spark, sf):
    """The opening of each fiftieth document as a question over the incidents of its own severity; hits and where they come from."""
    chunks, encoder, index = knowledge_base(spark, sf)
    asked = chunks.filter("doc_id % 50 = 0 AND chunk_index = 0").select(F.col("doc_id").alias("query_id"), F.substring("chunk", 1, 200).alias("question"), "severity")
    hits = V.ask(index, encoder, asked, 5, match=("severity",), document_type="synthetic_incident")
    return hits.select("query_id", "rank", "chunk_id", "doc_id", "severity", F.round("distance", 4).alias("distance"))


@query("ask_corpus_self", CHUNKS + "SELECT doc_id AS query_id, TRUE AS found FROM chunks WHERE doc_id % 50 = 0 AND chunk_index = 0 AND regexp_matches(chunk, '[\\p{L}\\p{N}]')")
def ask_corpus_self(spark, sf):
    """A whole chunk as the question finds a chunk at no distance, itself or one of the same words."""
    chunks, encoder, index = knowledge_base(spark, sf)
    asked = chunks.filter("doc_id % 50 = 0 AND chunk_index = 0").select(F.col("doc_id").alias("query_id"), F.col("chunk").alias("question"))
    return V.ask(index, encoder, asked, 1, synthetic_only=False).select("query_id", (F.col("distance") < 1e-4).alias("found"))


ASKED = with_views("evidence_corpus") + """,
long AS (SELECT event_type, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT event_type, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM vectors)),
centre AS (SELECT event_type AS query_id, i, avg(x) AS m FROM long GROUP BY event_type, i UNION ALL SELECT 'heat_dissipation_failure', i, avg(x) FROM long GROUP BY i),
raw AS (SELECT query_id, list(m ORDER BY i) AS v, sqrt(sum(m * m)) AS n FROM centre GROUP BY query_id),
asked AS (SELECT query_id, [x / n FOR x IN v] AS vector, query_id AS event_type, CASE WHEN query_id = 'event_1' THEN 'High' END AS severity FROM raw),
pairs AS (SELECT c.*, a.query_id, a.event_type AS wanted_event, a.severity AS wanted_severity, 2 - 2 * list_dot_product([CAST(e AS DOUBLE) FOR e IN embedding], vector) AS d
 FROM evidence_corpus c, asked a WHERE is_synthetic)
"""


def asked(spark, sf):
    """One question per event type, its vector the centre of that type, and one of an event type the corpus lacks."""
    vectors = view(spark, sf, "vectors")
    long = vectors.select("event_type", F.posexplode("embedding").alias("i", "x"))
    per_type = long.groupBy(F.col("event_type").alias("query_id"), "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    overall = long.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).withColumn("query_id", F.lit("heat_dissipation_failure"))
    raw = per_type.unionByName(overall).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return raw.select("query_id", F.transform("v", lambda x: x["m"] / F.col("n")).alias("vector"), F.col("query_id").alias("event_type"),
                      F.when(F.col("query_id") == "event_1", "High").alias("severity"))


def shown(hits, *columns):
    return hits.select("query_id", "vec_id", *columns, F.round("distance", 6).alias("distance"))


def stored_index(spark, sf, corpus="vectors"):
    """The index of a corpus as a later session opens it."""
    path = scratch_path(spark, "index")
    VI.build_index(view(spark, sf, corpus), path)
    return VI.open_index(spark, path)


TOP = ", {n} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), vec_id) AS INT) AS rank FROM pairs WHERE {where}) WHERE rank <= {k})\n"


@query("similarity_topk", ASKED + TOP.format(n="h", where="TRUE", k=5) + "SELECT query_id, vec_id, rank, round(d, 6) AS distance FROM h")
def similarity_topk(spark, sf):
    hits = V.similarity_topk(V.keep_filters(view(spark, sf, "vectors")), asked(spark, sf), 5)
    return shown(hits, "rank")


@query("retrieve", ASKED + TOP.format(n="h", where="document_type = 'synthetic_incident' AND event_type = wanted_event AND severity = coalesce(wanted_severity, severity)", k=5)
       + "SELECT query_id, vec_id, rank, round(d, 6) AS distance, event_type, severity FROM h")
def retrieve(spark, sf):
    hits = V.retrieve(stored_index(spark, sf), asked(spark, sf), 5, ("event_type", "severity"), document_type="synthetic_incident")
    return shown(hits, "rank", "event_type", "severity")


@query("retrieve_approx", ASKED + TOP.format(n="h", where="TRUE", k=5) + "SELECT query_id, count(*) AS hits, TRUE AS recalled FROM h GROUP BY query_id")
def retrieve_approx(spark, sf):
    """Hits of a search that stops after three quarters of the cells, and whether at least four of the five nearest rows are among them."""
    index, questions = stored_index(spark, sf), asked(spark, sf)
    found = VI.search(index, questions, 5, where=V.keep_condition(), probes=max(1, 3 * len(index.cells) // 4)).select("query_id", "vec_id")
    exact = V.similarity_topk(V.keep_filters(view(spark, sf, "vectors")), questions, 5).select("query_id", "vec_id", F.lit(True).alias("near"))
    both = found.join(exact, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("*").alias("hits"), F.count("near").alias("near"))
    return both.select("query_id", "hits", (F.col("near") >= 0.8 * F.col("hits")).alias("recalled"))


@query("evidence_rank", ASKED + TOP.format(n="h", where="event_type = wanted_event", k=20) + "SELECT query_id, vec_id, rank FROM h")
def evidence_rank(spark, sf):
    """Hits of each question's own event type, numbered by distance."""
    hits = V.similarity_topk(V.keep_filters(view(spark, sf, "vectors")), asked(spark, sf), 20, ("event_type",))
    return hits.select("query_id", "vec_id", "rank")


FALLBACK = (ASKED + TOP.format(n="f", where="document_type = 'synthetic_incident' AND event_type = wanted_event AND severity = coalesce(wanted_severity, severity)", k=6)
            + TOP.format(n="u", where="document_type = 'synthetic_incident'", k=6) + """,
short AS (SELECT query_id FROM asked WHERE (SELECT count(*) FROM f WHERE f.query_id = asked.query_id) < 2),
x AS (SELECT * FROM u WHERE query_id IN (SELECT query_id FROM short) AND incident_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = u.query_id AND f.incident_id = u.incident_id)
      QUALIFY row_number() OVER (PARTITION BY query_id, incident_id ORDER BY round(d, 6), vec_id) = 1),
fb AS (SELECT * FROM (SELECT *, 0 AS added FROM f UNION ALL SELECT *, 1 FROM x)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY added, round(d, 6), vec_id) <= 6)
""")


def _fallback(spark, sf, corpus="evidence_corpus"):
    parts = {"filtered": ("synthetic_incident", ("event_type", "severity")), "unfiltered": ("synthetic_incident", ())}
    found = V.searches(stored_index(spark, sf, corpus), asked(spark, sf), 6, parts)
    return V.with_fallback(found["filtered"], found["unfiltered"], 6)


@query("fallback_evidence", FALLBACK + "SELECT query_id, vec_id, incident_id, round(d, 6) AS distance FROM fb")
def fallback_evidence(spark, sf):
    return shown(_fallback(spark, sf, "vectors"), "incident_id")


DEDUPED = FALLBACK + """, di AS (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY query_id, incident_id, source ORDER BY round(d, 6), vec_id) = 1)
"""


@query("dedupe_evidence", DEDUPED + "SELECT query_id, vec_id, incident_id, source, round(d, 6) AS distance FROM di")
def dedupe_evidence(spark, sf):
    return shown(V.dedupe_evidence(_fallback(spark, sf, "vectors"), "incident_id"), "incident_id", "source")


CHOSEN = (DEDUPED + TOP.format(n="pr", where="document_type = 'safety_procedure'", k=6) + """,
w AS (SELECT *, len([t FOR t IN string_split_regex(lower(replace(wanted_event, '_', ' ')), '\\s+') IF len(t) > 3
   AND contains(concat_ws(' ', lower(coalesce(source, '')), lower(coalesce(text, ''))), t)]) > 0 AS hit FROM pr),
rp AS (SELECT * FROM (SELECT *, max(CAST(hit AS INT)) OVER (PARTITION BY query_id) AS anyhit FROM w) WHERE anyhit = 0 OR hit),
dp AS (SELECT * FROM rp QUALIFY row_number() OVER (PARTITION BY query_id, procedure_id, source ORDER BY round(d, 6), vec_id) = 1),
e AS (SELECT query_id, vec_id, d, 'incident' AS role, incident_id, procedure_id, source, document_type, evidence_type, event_type, severity, is_synthetic, text FROM di
 UNION ALL SELECT query_id, vec_id, d, 'procedure', incident_id, procedure_id, source, document_type, evidence_type, event_type, severity, is_synthetic, text FROM dp),
ep AS (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY round(d, 6), vec_id) AS place, CAST(count_if(role = 'incident') OVER (PARTITION BY query_id) AS INT) AS ni,
 CAST(count_if(role = 'procedure') OVER (PARTITION BY query_id) AS INT) AS np FROM e),
ec AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), vec_id) AS INT) AS final_rank FROM ep
 WHERE place <= CASE WHEN ni = 0 OR np = 0 THEN 6 WHEN role = 'incident' THEN least(ni, 3) ELSE 6 - least(ni, 3) END)
""")


def chosen(spark, sf):
    return V.incident_evidence(stored_index(spark, sf, "evidence_corpus"), asked(spark, sf), 6)


@query("incident_evidence", CHOSEN + "SELECT query_id, vec_id, role AS retrieval_role, final_rank, round(d, 6) AS distance FROM ec")
def incident_evidence(spark, sf):
    return shown(chosen(spark, sf), "retrieval_role", "final_rank")


@query("union_evidence", CHOSEN + "SELECT role AS retrieval_role, count(*) AS n FROM e GROUP BY role")
def union_evidence(spark, sf):
    both = V.evidence_parts(stored_index(spark, sf, "evidence_corpus"), asked(spark, sf), 6)
    return both.groupBy("retrieval_role").agg(F.count("*").alias("n"))


@query("balanced_evidence", ASKED + TOP.format(n="pr", where="document_type = 'safety_procedure'", k=2) + TOP.format(n="inc", where="document_type = 'synthetic_incident' AND event_type = wanted_event", k=2)
       + """SELECT query_id, vec_id, role AS retrieval_role, rk AS rank, round(d, 6) AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), vec_id) AS INT) AS rk
 FROM (SELECT *, 'procedure' AS role FROM pr UNION ALL SELECT *, 'incident' FROM inc)) WHERE rk <= 5""")
def balanced_evidence(spark, sf):
    hits = V.balanced_evidence(stored_index(spark, sf), asked(spark, sf), 5, ("event_type",))
    return shown(hits, "retrieval_role", "rank")


FORMATTED = CHOSEN + f""", blocks AS (SELECT query_id, final_rank, concat('[Evidence ', final_rank, ']', chr(10), 'Source: ', coalesce(source, 'Unknown source'), chr(10), 'Document Type: ', document_type, chr(10),
 'Evidence Type: ', evidence_type, chr(10), 'Incident ID: ', coalesce(incident_id, 'Not applicable'), chr(10), 'Procedure ID: ', coalesce(procedure_id, 'Not applicable'), chr(10),
 'Event Type: ', coalesce(event_type, 'Not specified'), chr(10), 'Severity: ', coalesce(severity, 'Not specified'), chr(10), 'Synthetic Record: ', CASE WHEN is_synthetic THEN 'True' ELSE 'False' END, chr(10),
 'Retrieval Distance: ', printf('%.4f', d), chr(10), 'Content:', chr(10), coalesce(text, '')) AS b FROM ec),
formatted AS (SELECT asked.query_id, coalesce(string_agg(b, chr(10) || chr(10) ORDER BY final_rank), {sql_text(T.NO_EVIDENCE)}) AS evidence_text FROM asked LEFT JOIN blocks USING (query_id) GROUP BY asked.query_id)
"""


@query("format_evidence", FORMATTED + "SELECT query_id, evidence_text FROM formatted")
def format_evidence(spark, sf):
    return V.format_evidence(chosen(spark, sf), asked(spark, sf), "final_rank")


@query("prompt_batch", FORMATTED + f"""SELECT query_id, concat({sql_text(V.INSTRUCTIONS)}, chr(10), chr(10), 'QUESTION', chr(10), '{T.SEARCHES["incident"][0]}',
 replace(query_id, '_', ' '), chr(10), chr(10), 'EVIDENCE', chr(10), evidence_text) AS prompt FROM formatted""")
def prompt_batch(spark, sf):
    questions = asked(spark, sf).select("query_id", T.event_query("event_type", "incident").alias("question"))
    return V.prompt_batch(V.format_evidence(chosen(spark, sf), questions, "final_rank"), questions)


@query("evidence_table", CHOSEN + """SELECT query_id, final_rank, coalesce(incident_id, procedure_id, concat('EVIDENCE-', final_rank)) AS evidence_id,
 coalesce(evidence_type, document_type) AS kind, coalesce(event_type, 'Unknown') AS event, round(d, 6) AS distance FROM ec""")
def evidence_table(spark, sf):
    return V.evidence_table(chosen(spark, sf), "final_rank").withColumn("distance", F.round("distance", 6))


def searched(kind):
    before, after, general = T.SEARCHES[kind]
    return f"CASE WHEN event_type IS NULL THEN '{general}' ELSE concat('{before}', replace(event_type, '_', ' '), '{after}') END AS {kind}_query"


@query("evidence_queries", f"""SELECT event_type, {searched('incident')}, {searched('procedure')}, count(*) AS n
FROM (SELECT nullif(event_type, 'view') AS event_type FROM events) GROUP BY event_type""")
def evidence_queries(spark, sf):
    events = view(spark, sf, "events").select(F.expr("nullif(event_type, 'view')").alias("event_type"))
    counted = events.groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.select("event_type", T.event_query("event_type", "incident").alias("incident_query"), T.event_query("event_type", "procedure").alias("procedure_query"), "n")


def cited(x, pattern):
    return f"list_sort(list_distinct(regexp_extract_all({x}, {sql_text(pattern)})))"


INC, SOP = cited("answer", T.INCIDENT_PATTERN), cited("answer", T.PROCEDURE_PATTERN)
CITED = with_views("answers") + f""", c AS (SELECT *, {INC} AS inc, {SOP} AS sop, [x FOR x IN {INC} IF x <> retrieved_incident] AS bad_inc, [x FOR x IN {SOP} IF x <> retrieved_procedure] AS bad_sop FROM answers)
"""


@query("validate_citations", CITED + f"""SELECT doc_id, len(bad_inc) = 0 AND len(bad_sop) = 0 AS valid, retrieved_incident AS valid_incident_ids, retrieved_procedure AS valid_procedure_ids,
 {joined('inc')} AS cited_incident_ids, {joined('sop')} AS cited_procedure_ids, {joined('bad_inc')} AS invalid_incident_ids, {joined('bad_sop')} AS invalid_procedure_ids FROM c""")
def validate_citations(spark, sf):
    answers = view(spark, sf, "answers").withColumns({"incidents": F.array("retrieved_incident"), "procedures": F.array("retrieved_procedure")})
    checked = D.validate_citations(answers, "answer", "incidents", "procedures", ["doc_id"])
    return checked.select("doc_id", "valid", *[F.array_join(c, "|").alias(c) for c in checked.columns if c.endswith("_ids")])


@query("unsupported_citations", CITED + f"SELECT doc_id, {joined('list_sort(list_concat(bad_inc, bad_sop))')} AS unsupported FROM c WHERE len(bad_inc) + len(bad_sop) > 0")
def unsupported_citations(spark, sf):
    known = F.array("retrieved_incident", "retrieved_procedure")
    lost = view(spark, sf, "answers").withColumn("lost", F.array_except(T.cited_ids("answer"), known))
    return lost.filter(F.size("lost") > 0).select("doc_id", F.array_join("lost", "|").alias("unsupported"))


@query("cited_ids_union", CITED + f"SELECT doc_id, {joined('list_sort(list_concat(inc, sop))')} AS cited FROM c")
def cited_ids_union(spark, sf):
    return view(spark, sf, "answers").select("doc_id", F.array_join(T.cited_ids("answer"), "|").alias("cited"))


@query("ordered_citations", with_views("reports") + f""", e AS (SELECT doc_id, regexp_extract_all(report, {sql_text(T.CITATION_PATTERN)}) AS ids FROM reports)
SELECT doc_id, {joined('[x FOR x, i IN ids IF list_position(ids, x) = i]')} AS cited FROM e""")
def ordered_citations(spark, sf):
    return view(spark, sf, "reports").select("doc_id", F.array_join(T.ordered_citations("report"), "|").alias("cited"))


def report_section(x, heading):
    plain = f"lower(regexp_replace({strip('l')}, '^##\\s+', ''))"
    names = "[" + ", ".join(f"'{h.lower()}'" for h in T.REQUIRED_SECTIONS) + "]"
    return plain, names


_PLAIN, _NAMES = report_section("report", "")


@query("report_sections", with_views("reports") + f""", l AS (SELECT doc_id, unnest(string_split(report, chr(10))) AS l, generate_subscripts(string_split(report, chr(10)), 1) AS i FROM reports),
t AS (SELECT *, {_PLAIN} AS name, starts_with(l, '## ') OR list_contains({_NAMES}, {_PLAIN}) AS head FROM l),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM t),
h AS (SELECT doc_id, name, min(part) AS part FROM g WHERE head GROUP BY doc_id, name)
SELECT r.doc_id, s.heading, md5(coalesce({strip("string_agg(g.l, chr(10) ORDER BY g.i) FILTER (WHERE NOT g.head)")}, '')) AS body_md5
FROM reports r, (VALUES ('FACTS'), ('POSSIBLE HYPOTHESES'), ('RECOMMENDED ACTIONS'), ('EVIDENCE SOURCES'), ('LIMITATIONS')) s(heading)
LEFT JOIN h ON h.doc_id = r.doc_id AND h.name = lower(s.heading) LEFT JOIN g ON g.doc_id = r.doc_id AND g.part = h.part GROUP BY r.doc_id, s.heading""")
def report_sections(spark, sf):
    wanted = ("FACTS", "POSSIBLE HYPOTHESES", "RECOMMENDED ACTIONS", "EVIDENCE SOURCES", "LIMITATIONS")
    parts = [F.struct(F.lit(h).alias("heading"), F.md5(T.report_section("report", h)).alias("body_md5")) for h in wanted]
    return view(spark, sf, "reports").select("doc_id", F.inline(F.array(*parts)))


MISSING = "[s FOR s IN ['FACTS', 'POSSIBLE HYPOTHESES', 'RECOMMENDED ACTIONS', 'EVIDENCE SOURCES', 'LIMITATIONS'] IF NOT contains(upper(answer), s)]"
GROUNDED = CITED + f""", g AS (SELECT doc_id, len({MISSING}) = 0 AS sections_complete, len(bad_inc) + len(bad_sop) = 0 AS citation_grounded,
 CASE WHEN expected_supported THEN NOT contains(lower(answer), {sql_text(T.INSUFFICIENT)}) ELSE contains(lower(answer), {sql_text(T.INSUFFICIENT)})
  OR contains(lower(answer), 'does not include') OR (contains(lower(answer), 'no ') AND contains(lower(answer), 'evidence')) END AS insufficient_behavior_correct,
 contains(lower(answer), 'synthetic') AS synthetic_disclosed, {joined('list_sort(list_concat(bad_inc, bad_sop))')} AS unsupported_ids, {joined(MISSING)} AS missing_sections FROM c),
gs AS (SELECT *, CAST(sections_complete AS INT) + CAST(citation_grounded AS INT) + CAST(insufficient_behavior_correct AS INT) + CAST(synthetic_disclosed AS INT) AS passed_checks FROM g)
"""


def grounded(spark, sf):
    answers = view(spark, sf, "answers").withColumn("retrieved", F.array("retrieved_incident", "retrieved_procedure"))
    return D.grounding_checks(answers, "answer", "retrieved", "expected_supported", ["doc_id"])


@query("grounding_checks", GROUNDED + "SELECT *, round_even(passed_checks / 4, 3) AS grounding_score FROM gs")
def grounding_checks(spark, sf):
    return grounded(spark, sf).select("doc_id", *D.CHECKS, F.array_join("unsupported_ids", "|").alias("unsupported_ids"),
                                      F.array_join("missing_sections", "|").alias("missing_sections"), "passed_checks", "grounding_score")


@query("grounding_summary", GROUNDED + """SELECT count(*) AS cases, round_even(avg(round_even(passed_checks / 4, 3)), 3) AS mean_score, """ + ", ".join(
    f"round_even(avg(CAST({c} AS INT)), 3) AS {c}_rate" for c in D.CHECKS) + " FROM gs")
def grounding_summary(spark, sf):
    return D.grounding_summary(grounded(spark, sf))


@query("report_preview", with_views("reports") + f""", k AS (SELECT doc_id, [x FOR x IN {lines('report')} IF x <> ''] AS kept FROM reports)
SELECT doc_id, left(replace(array_to_string(kept[1:2], ' '), '**', ''), 250) AS preview FROM k""")
def report_preview(spark, sf):
    return view(spark, sf, "reports").select("doc_id", T.preview("report").alias("preview"))
