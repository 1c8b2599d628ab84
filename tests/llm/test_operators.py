"""The training-data operators on small fixtures, against brute force, round trips and held-out rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwarden.llm import bitplanes, components, fingerprints, licences, neardup, packing, quality, sharding, templates, tokencount, toxicity, warc
from millwarden.llm.encoding import CUT, encoded, segments
from millwarden.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def frame(spark, rows, kinds="doc_id long, text string"):
    return spark.createDataFrame(rows, kinds)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def edge_rows():
    """Nulls, empty and odd texts, repeated rows and keys, ties."""
    long_text = " ".join(f"word{k % 997}" for k in range(60_000))
    return [(1, "One plain text. It has two sentences."), (1, "One plain text. It has two sentences."), (2, None), (None, "no key here"), (3, ""), (4, " \t\n"),
            (5, long_text), (6, "x" * 70_000), (7, "One plain text. It has two sentences."), (7, "another text of the same key"), (None, None)]


@pytest.fixture(scope="module")
def edge(spark, edge_rows):
    """The same with columns whose names the operators use themselves."""
    return frame(spark, edge_rows).withColumns({"n_tokens": F.lit("own"), "measures": F.lit("own"), "toxicity": F.lit("own"), "node": F.lit("own"), "KEY": F.lit(1)})


def brute_measures(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k:k + 8]), []).append(k)
    covered = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(8)}
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\n\x0b\f\r" for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(["a b c d e f g h ", "\n", "# ", "é ", "x\x0by ", "a b c d e f g h i\n", " \t"]) for _ in range(rng.randrange(12)))) for k in range(200)]
    rows += [(1000, None), (1001, "same line\nsame line\n\nsame line"), (1002, "a b c d e f g h " * 400)]
    got = quality.measured(frame(spark, rows)).select("doc_id", "measures.*").collect()
    texts = dict(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(texts[r.doc_id])


def test_quality_edges_and_empty(spark, edge):
    kept = quality.filter_quality(edge)
    assert kept.columns == edge.columns
    assert all(r.text for r in kept.collect())
    empty = edge.limit(0)
    assert quality.filter_quality(empty).count() == 0
    rated = quality.measured(frame(spark, [(1, None), (2, "")]))
    assert [r.kept for r in quality.rate(rated, quality.fit_rules(rated)).collect()] == [False, False]


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rated = quality.measured(docs)
    done = quality.rate(rated, quality.fit_rules(rated)).filter("NOT base_failed").select("doc_id", "kept").join(labels, "doc_id")
    found = {(r.label, r.kept): r["count"] for r in done.groupBy(F.col("quality").alias("label"), "kept").count().collect()}
    assert found.get((1, False), 0) <= 0.02 * found[(1, True)]
    assert found.get((0, True), 0) <= 0.1 * found[(0, False)]


def test_quality_em_learns_a_useless_rule():
    model = quality.RuleModel(0.8, (((0.6, 0.02), (0.2, 0.3)), ((0.3, 0.1), (0.3, 0.1))))
    assert model.posterior((1, -1)) == model.posterior((1, 0)) > 0.9
    assert model.accuracies()[0] > model.accuracies()[1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_encoding_equals_the_library(name):
    rng = random.Random(7)
    bits = list("abAB .,  \n\t!é'ßж漢▁́ \x1f0<|>") + ["<|endoftext|>", "<|startoftext|>", " the ", " and", "'s ", "\r\n", "</s>", " foo bar", "İ", "Σ "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(4000)] + [prose(rng, 40_000), None]
    if name.endswith(".model"):
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name)).encode([t or "" for t in texts])
    else:
        from tokenizers import Tokenizer

        want = [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = list(encoded(vocabulary(name), enumerate(texts), 3000))
    assert [k for k, _ in got] == list(range(len(texts)))
    assert all(ids.tolist() == list(w) for (_, ids), w in zip(got, want))


def test_segments_rejoin():
    text = prose(random.Random(1), 5000)
    parts = list(segments(text, 100))
    assert " ".join(p for p, _ in parts) == text and [f for _, f in parts] == [True] + [False] * (len(parts) - 1)
    assert [p for p, _ in segments("x" * 500, 100)] == ["x" * 500] and CUT.split("a  b") == ["a  b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, edge, edge_rows, name):
    want = sorted(((k, len((t or "").encode()), len(ids)) for (k, t), (_, ids) in zip(edge_rows, encoded(vocabulary(name), edge_rows))), key=str)
    got = tokencount.count_tokens(edge, vocabulary(name), batch_bytes=500).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert tokencount.count_tokens(edge.limit(0), vocabulary(name)).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("top", [0, 1, 255, 50_256, 70_000, 2**32 - 1])
def test_planes_round_trip(kind, top):
    ids = np.random.default_rng(1).integers(0, top + 1, 1003, dtype=np.uint64).astype("<u4")
    assert (bitplanes.from_planes(bitplanes.to_planes(ids, kind), len(ids), kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files(spark, edge, edge_rows, kind):
    got = bitplanes.read_ids(bitplanes.write_ids(edge, vocabulary("byte_bpe_50k.json"), kind=kind, block=1000)).orderBy("start").collect()
    ids = {(k, len(i) + 1, zlib.crc32(np.append(i, np.uint32(0)).tobytes())) for (k, _), (_, i) in zip(edge_rows, encoded(vocabulary("byte_bpe_50k.json"), edge_rows))}
    assert len(got) == len(edge_rows) and {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == ids
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert bitplanes.read_ids(bitplanes.write_ids(edge.limit(0), vocabulary("byte_bpe_50k.json"))).count() == 0


def brute_cost(places, pen, length):
    cost = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        options = [cost[i] + packing.padding(places[j] - places[i], length) if places[j] - places[i] in packing.POWERS else cost[i] + length - (places[j] - places[i])
                   for i in range(j) if places[j] - places[i] <= length]
        cost[j] = min(options) + pen[j]
    return cost[-1]


def test_cuts_are_optimal():
    rng = random.Random(11)
    for _ in range(40):
        places = sorted({0, *(rng.randrange(1, 9000) for _ in range(rng.randrange(20, 80)))})
        places = sorted(set(places) | set(range(0, places[-1], 1500)))
        pen = [rng.choice([0, 4, 32]) for _ in places]
        cuts, cost, at = packing.best_cuts(places, pen), 0, 0
        for cut in cuts:
            assert 0 < cut - at <= 2048
            cost += (packing.padding(cut - at) if cut - at in packing.POWERS else 2048 - (cut - at)) + pen[places.index(cut)]
            at = cut
        assert at == places[-1] and cost == brute_cost(places, pen, 2048)


def test_packing_keeps_every_id(spark, edge, edge_rows):
    got = packing.pack(edge, vocabulary("word_bpe_49k.json"), with_ids=True).collect()
    whole = sorted(((str(k), np.append(ids, np.uint32(1)).tolist()) for (k, _), (_, ids) in zip(edge_rows, encoded(vocabulary("word_bpe_49k.json"), edge_rows))))
    pieces, rebuilt = sorted(got, key=lambda r: (r.sequence_id, r.offset)), []
    for r in pieces:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        if r.start == 0:
            rebuilt.append((str(r.doc_id), []))
        assert r.start == len(rebuilt[-1][1])
        rebuilt[-1][1].extend(r.ids)
        assert len(rebuilt[-1][1]) <= r.doc_tokens
    assert sorted(rebuilt) == whole
    sizes = {}
    for r in pieces:
        assert r.offset == sizes.get(r.sequence_id, 0)
        sizes[r.sequence_id] = r.offset + r.length
    assert max(sizes.values()) <= 2048 and sum(map(packing.padding, sizes.values())) <= 0.03 * sum(sizes.values())
    assert packing.pack(edge.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_ftrl_learns_and_is_sparse():
    rng = random.Random(5)
    rows = []
    for k in range(600):
        toxic = k % 3 == 0
        rows.append((np.unique(toxicity.features(prose(rng, 30) + (" nasty stuff" if toxic else " fine stuff"), toxicity.WordHashes())), int(toxic)))
    state = toxicity.State()
    for _ in range(3):
        state = toxicity.train(rows, state)
    w = toxicity.weights(state.z, state.n)
    assert 0 < (w != 0).sum() < 0.05 * len(w)
    score = toxicity.Model(state.index[w != 0], w[w != 0], 0.0).scorer()
    assert score(toxicity.features("so nasty stuff", toxicity.WordHashes())) > 0.5 > score(toxicity.features("so fine stuff", toxicity.WordHashes()))


def test_toxicity_held_out_and_edges(spark, edge):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).filter(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id")
    found = {(r.toxic, r.hit): r["count"] for r in scored.groupBy("toxic", (F.col("toxicity") >= 0.5).alias("hit")).count().collect()}
    assert found[(1, True)] >= 0.65 * (found[(1, True)] + found[(1, False)]) and found.get((0, True), 0) <= 0.01 * found[(0, False)]
    assert scored.filter("toxicity < 0 OR toxicity > 1").isEmpty()
    none = toxicity.fit(edge, frame(spark, [(1, None), (None, 1)], "doc_id long, toxic int"))
    out = toxicity.score(edge, none)
    assert out.columns == [*edge.columns, "toxicity_1"] and {round(r.toxicity_1, 6) for r in out.collect()} == {0.25}
    assert toxicity.score(edge.limit(0), none).count() == 0


def test_toxicity_verdicts_hold_under_a_small_sample(spark):
    """A word of all toxic texts and of two fifths of the clean ones, nine times as many: more likely clean."""
    rng, common = random.Random(3), [f"plain{k}" for k in range(30)]
    rows = [(k, " ".join(rng.sample(common, 8) + ["edgy"] * (k % 10 == 0 or rng.random() < 0.4)), int(k % 10 == 0)) for k in range(3000)]
    docs = frame(spark, [r[:2] for r in rows])
    labels = frame(spark, [(k, y) for k, _, y in rows], "doc_id long, toxic int")
    texts = frame(spark, [(k, " ".join(rng.sample(common, 8) + ["edgy"])) for k in range(200)])
    flagged = {}
    for sample in (toxicity.SAMPLE, 150):
        scores = [r.toxicity for r in toxicity.score(texts, toxicity.fit(docs, labels, sample=sample)).collect()]
        flagged[sample] = sum(s >= 0.5 for s in scores)
    assert max(flagged.values()) < 100, flagged


def brute_components(rows):
    sets = []
    for key, text in rows:
        words = [w.decode() for w in neardup.words_in((text or "").encode())]
        sets.append((key, {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    label = {key: key for key, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, s in sets:
            for b, t in sets:
                if s and t and 100 * len(s & t) >= 75 * len(s | t) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {key: (len(s), label[key]) for key, s in sets}


def test_near_duplicates_against_brute_force(spark):
    rng, rows = random.Random(9), []
    for group in range(25):
        base = prose(rng, rng.choice([3, 30, 80, 200])).split()
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 60) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, " \n"), (len(rows) + 2, "short text"), (len(rows) + 3, "SHORT\ttext")]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_star_of_copies_is_one_component(spark):
    """Copies that each differ from the source in other places are like the source only."""
    rng = random.Random(4)
    base = prose(rng, 400).split()
    rows = [(500, " ".join(base))]
    for k in range(150):
        copy = list(base)
        for p in range(10):
            copy[(k * 2 + p * 40) % 400] = f"new{k}x{p}"
        rows.append((k, " ".join(copy)))
    got = {r.component_id for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {v for _, v in brute_components(rows).values()}


def test_links_between_texts_of_common_boilerplate(spark):
    """Texts that differ from a common one, which is absent; two that differ in the same places are just over the bound, others far under it."""
    rng, rows = random.Random(12), []
    for pair in range(70):
        places = rng.sample(range(6, 390, 6), 11)
        for own in "ab":
            words = [f"shared{k}" for k in range(400)]
            for p in places:
                words[p] = f"new{pair}{own}{p}"
            rows.append((len(rows), " ".join(words)))
    want = brute_components(rows)
    assert len({v for _, v in want.values()}) == 70
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicate_edges(spark, edge, edge_rows):
    got = neardup.near_duplicates(edge).collect()
    assert len(got) == len(edge_rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (None, None), (3, 3), (4, 4), (5, 5), (6, 6), (7, 1), (7, 7)}
    assert neardup.near_duplicates(edge.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = frame(spark, [(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "same payload " * 20 + "</p>"
    rows = [(5, "http://a/ x\ny", body), (3, "http://b/", body), (9, None, body), (1, "http://c/", "tiny"), (2, "http://d/", "tiny"), (7, "http://e/", None),
            (8, "http://f/", "é" * 60_000), (None, "http://g/", body), (10, "http://h/", "")]
    pages = frame(spark, rows, "page_id long, url string, html string").withColumn("payload", F.lit("own"))
    folder = f"file://{tmp_path}/archive"
    warc.write_warc(warc.page_records(pages), folder)
    got = {warc_key(r): r for r in warc.read_warc(spark, folder).collect()}
    assert len(got) == len(rows)
    for key, url, html in rows:
        r, payload = got[key], (html or "").encode()
        assert r.payload_length == len(payload) and r.payload_digest == hashlib.sha256(payload).hexdigest()
        if html == body and key != 3:
            assert (r.record_type, r.payload, r.refers_to) == ("revisit", None, "<urn:page:3>")
        else:
            assert (r.record_type, bytes(r.payload), r.refers_to) == ("response", payload, None)
    assert got[5].target_uri == "http://a/%20x%0Ay" and got[9].target_uri is None
    headers = warc.read_warc(spark, folder, payload=False).filter("record_type = 'revisit' AND target_uri LIKE 'http://%'")
    assert {warc_key(r) for r in headers.collect()} == {5, None}
    assert "PushedFilters" not in headers.columns and headers.filter("record_id IN ('<urn:page:5>', '<urn:page:1>')").count() == 1
    empty = f"file://{tmp_path}/empty"
    warc.write_warc(warc.page_records(pages.limit(0)), empty)
    assert warc.read_warc(spark, empty).count() == 0


def warc_key(r):
    text = r.record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def test_warc_skips_and_plain_members(tmp_path):
    """Unwanted records are left after their headers; members of other writers, without lengths, are read too."""
    import gzip

    raw = [warc.record("response", f"<urn:page:{k}>", f"http://x/{k}", b"z" * 50_000 * k, "00", 50_000 * k, None) for k in range(4)]
    for name, pack in (("own", warc.member), ("gzip", gzip.compress)):
        path = tmp_path / name
        path.write_bytes(b"".join(map(pack, raw)))
        with open(path, "rb") as file:
            found = list(warc.records(file, path.stat().st_size, lambda h: h["warc-record-id"] != "<urn:page:2>", True))
        assert [len(body) for _, body in found] == [0, 50_000, 150_000]
    with open(tmp_path / "own", "rb") as file:
        reads, plain = [], file.read

        class Counted:
            seek, tell = file.seek, file.tell

            def read(self, n):
                reads.append(n)
                return plain(n)

        assert len(list(warc.records(Counted(), (tmp_path / "own").stat().st_size, lambda h: False, True))) == 0
        assert sum(reads) == 4 * warc.HEAD


def test_shards_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, "x" * rng.randrange(0, 200)) for k in range(400)] + [(1000, "y" * 900), (1001, None)]
    got = {r.doc_id: r for r in sharding.assign_shards(frame(spark, rows), limit=700, step=3).collect()}
    bits = {k: bin(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16))[2:].zfill(60) for k, _ in rows}
    for key, text in rows:
        for d in range(61):
            inside = [(k, len(t or "")) for k, t in rows if bits[k][:d] == bits[key][:d]]
            if sum(n for _, n in inside) <= 700 or len(inside) == 1:
                break
        r = got[key]
        assert (r.n_bytes, r.shard, r.shard_bytes, r.shard_rows) == (len(text or ""), bits[key][:d], sum(n for _, n in inside), len(inside))


def test_shards_of_repeated_rows(spark, edge):
    rows = [(1, "x" * 100)] * 40 + [(1, "z" * 100)] * 5 + [(None, None)]
    got = sharding.assign_shards(frame(spark, rows), limit=1000).collect()
    assert len(got) == 46 and all(r.shard_bytes <= 1000 for r in got)
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
    assert all(sums[r.shard] == r.shard_bytes for r in got)
    assert sharding.assign_shards(edge.limit(0)).count() == 0 and sharding.assign_shards(edge).count() == edge.count()


def test_shard_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    directory = sharding.write_shards(docs, f"{tmp_path}/shards", limit=50_000).collect()
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.drop("_shard").exceptAll(docs).isEmpty() and back.count() == docs.count() == sum(r.shard_rows for r in directory)


def test_licences(spark, edge):
    mit = licences.KNOWN[0][1]
    rows = [(1, "Some prose.\nReleased under the MIT License.\nMore."), (2, "Copyright (c) 2020 Someone\n\n" + mit.replace("Software", "SOFTWARE").replace("\n", " ").replace(". ", ".\n\n")),
            (3, "RELEASED UNDER THE MIT LICENCE"), (4, "Released under the MIT License and more"), (5, None), (6, "Released under the MIT License.\nReleased under the MIT license")]
    got = {(r.doc_id, r.licence, r.scope): r.places for r in licences.scan_licences(frame(spark, rows), licences.known_licences(spark)).collect()}
    assert got == {(1, "MIT", "line"): 1, (2, "MIT", "text"): 1, (3, "MIT", "line"): 1, (3, "MIT", "text"): 1, (6, "MIT", "line"): 2}
    assert licences.scan_licences(edge, licences.known_licences(spark)).count() == 0
    assert licences.scan_licences(edge.limit(0), licences.known_licences(spark)).count() == 0
    assert licences.scan_licences(frame(spark, rows), licences.known_licences(spark).limit(0)).count() == 0


def test_licence_notices_written_apart(spark):
    rows = [(1, "Some prose.\nLicensed under CC BY-NC 4.0.\nMore."), (2, "Licensed under CC-BY-SA-3.0"), (3, "This work is licensed under the CC BY v4.0 licence."),
            (4, "Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International Licence"), (5, "Licensed under CC BY-NC 9.0."),
            (6, """Copyright 2021 Someone
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""")]
    got = {(r.doc_id, r.licence, r.scope) for r in licences.scan_licences(frame(spark, rows), licences.known_licences(spark)).collect()}
    assert got == {(1, "CC-BY-NC-4.0", "line"), *((k, name, scope) for k, name in ((2, "CC-BY-SA-3.0"), (3, "CC-BY-4.0"), (4, "CC-BY-ND-4.0")) for scope in ("text", "line")),
                   (6, "Apache-2.0", "text"), (6, "Apache-2.0", "line")}


ITEM = "if the train leaves the town of Aston at 40 km per hour and the bus leaves Aston at 25 km per hour how far apart are they after 3 hours"


def test_templates(spark, edge):
    bench = frame(spark, [(1, ITEM), (1, ITEM), (2, "what is the name of the longest river there"), (3, None), (4, "too short")], "item_id long, text string")
    moved = ITEM.replace("Aston", "Burley").replace("40", "75").replace("25", "30")
    mixed = ITEM.replace("of Aston", "of Burley").replace("40", "75")
    rows = [(10, "Before that. " + ITEM + " and after."), (11, "prose " * 30 + moved.upper()[:0] + moved), (12, mixed), (13, "Nothing of the kind is here, nor anywhere else in it."),
            (14, "They ask: what is the name of the longest river there?"), (15, None), (16, ITEM.replace(" and the bus", ", and - the bus")), (17, "if the train leaves the town of Aston at 40")]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id): r.exact for r in templates.leaking_rows(docs, bench).collect()}
    assert got == {(10, 1): True, (11, 1): False, (14, 2): True, (16, 1): True}
    assert {r.doc_id for r in templates.decontaminate(docs.withColumn("text_hash", F.lit(1)), bench).collect()} == {12, 13, 15, 17}
    assert templates.decontaminate(edge, bench).columns == edge.columns and templates.decontaminate(edge, bench).count() == edge.count()
    assert templates.decontaminate(edge.limit(0), bench).count() == 0 and templates.decontaminate(docs, bench.limit(0)).count() == len(rows)


def brute_leaves(text):
    import re

    return re.findall(r"[^.!?\n]{1,48}(?:[.!?]+ *)?\n*|[.!?]+ *\n*|\n+", text)


def brute_following(rows):
    """Rows in descending order of key, nulls last, each with the text after it (rows of one key must share their text)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(k, t or "", rows[(n + 1) % len(rows)][1] or "") for n, (k, t) in enumerate(rows)]


@pytest.mark.parametrize("rows_of_bucket", [3, 50, 5000])
def test_fingerprints_against_brute_force(spark, rows_of_bucket):
    rng = random.Random(11)
    rows = [(rng.randrange(-10**6, 10**6) * 7, "".join(rng.choice(["Aé b. ", "\n", "\n\n", "c d e! ", "x" * 60, "ß漢", "."]) for _ in range(rng.randrange(30)))) for _ in range(300)]
    rows += [(5, "same text."), *[(6, "hot key\n\nof one text. ")] * 40, (None, None), *[(None, "")] * 20]
    got = sorted(fingerprints.fingerprint(frame(spark, rows).repartition(7), rows=rows_of_bucket).collect(), key=str)
    want = []
    for k, text, after in brute_following(rows):
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        weighed = [{x: len(x) for x in brute_leaves(t)} for t in (text, edited, after)]
        near = [1.0 if other == text else max(0.0, 1 - max(1, sum(n for x, n in {**a, **b}.items() if (x in a) != (x in b))) / max(1, sum(a.values()) + sum(b.values())))
                for a, b, other in ((weighed[0], weighed[1], edited), (weighed[0], weighed[2], after))]
        want.append((k, n, hashlib.sha256(edited.encode()).hexdigest(), *near))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str) == sorted(want, key=str)
    texts = {}
    for k, text, after in brute_following(rows):
        texts.setdefault((k, len(text)), text)
    roots = {}
    for r in got:
        roots.setdefault(texts[r.doc_id, r.n_chars], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in roots.values()) and len(set().union(*roots.values())) == len(roots)


def test_fingerprint_edges(spark, edge, edge_rows):
    got = fingerprints.fingerprint(edge, rows=2).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in got), key=str) == sorted(((k, len(t or "")) for k, t in edge_rows), key=str)
    assert fingerprints.fingerprint(edge.limit(0)).count() == 0
    alone = fingerprints.fingerprint(frame(spark, [(1, "One. Two.\nThree.")])).first()
    assert alone.near_next == 1.0 and alone.near_edited < 1


def test_edits_are_located(spark):
    old = "".join(f"Sentence {k} of it. And more {k}.\n" for k in range(200))
    new = old.replace("Sentence 77 of it. ", "Sentence 77 is new. ").replace("And more 150.\n", "")
    rows = [(1, old), (2, "unchanged"), (3, None), (None, "x")], [(1, new), (2, "unchanged"), (4, "Added.")]
    got = sorted((r.doc_id, r.side, r.start, r.n_chars) for r in fingerprints.locate_edits(*(frame(spark, r) for r in rows)).collect())
    at, ends = old.index("Sentence 77"), old.index("And more 150.")
    assert got == [(1, "new", at, 20), (1, "old", at, 19), (1, "old", ends, 14), (4, "new", 0, 6)]


def test_common_counts_against_sets():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 120)).astype(np.uint64)) for _ in range(60)] + [np.arange(200, dtype=np.uint64)] * 30
    for left, right in ((np.arange(90), np.arange(90)), (np.arange(0, 40), np.arange(40, 90))):
        got = neardup.common_counts(sets, left, right)
        want = [[0 if i == j else len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
        off = left[:, None] != right[None, :]
        assert (got[off] == np.array(want)[off]).all()


def boilerplate(n, seed=1, words=400, own=9):
    rng = random.Random(seed)
    base = [rng.choice(WORDS) + str(rng.randrange(200)) for _ in range(words)]
    rows = []
    for k in range(n):
        text = list(base)
        for at in rng.sample(range(words), own):
            text[at] = f"own{k}x{at}"
        rows.append((k, " ".join(text)))
    return rows


def test_links_of_crowded_regions_stay_linear(spark, monkeypatch):
    """Texts of one boilerplate: all components right, and no more rows leave the tasks than there are nodes."""
    monkeypatch.setattr(neardup, "BLOCK", 100)
    rows = boilerplate(350)
    rows += [(1000 + k, rows[k][1].replace("own", "another", 2)) for k in range(0, 350, 7)]
    seen, crowded = [], neardup._crowded_links

    def counted(*args):
        out = crowded(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_crowded_links", counted)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {k: component for k, (_, component) in brute_components(rows).items()}
    assert seen[0] <= 16 * len(rows)


def test_links_through_rows_without_a_key(spark):
    base = [f"w{k}" for k in range(100)]
    left, right = base[:94] + [f"l{k}" for k in range(6)], base[:94] + [f"r{k}" for k in range(6)]
    left[:2], right[2:4] = ["x1", "x2"], ["y1", "y2"]
    texts = [" ".join(left), " ".join(base), " ".join(right)]
    with_key = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, [(1, texts[0]), (3, texts[1]), (2, texts[2])])).collect()}
    without = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, [(1, texts[0]), (None, texts[1]), (2, texts[2])])).collect()}
    assert with_key == {1: 1, 2: 1, 3: 1} and without == {1: 1, 2: 1, None: 1}


def test_one_row_of_each_component_stays(spark):
    text, other = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, text), (1, other), (1, text), (2, text.upper()), (None, "c " * 30), (None, "c " * 30), (None, None), (None, ""), (5, " "), (5, " ")]
    docs = frame(spark, rows).withColumns({"_row": F.lit("own"), "times": F.lit("own"), "at": F.lit("own")})
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, text), (1, other), (None, "c " * 30), (None, None), (None, ""), (5, " "), (5, " ")], key=str)
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_templates_whatever_stands_before_and_in_any_case(spark):
    short, other = "How many legs do nine spiders have in total?", "What is the capital city of the old kingdom of Bavaria"
    names = "Anna has 5 apples. Ben gives her 3 more apples from his own small garden. How many apples does Anna have now?"
    bench = frame(spark, [(1, short), (2, other), (3, names), (4, "Name the four winds")], "item_id long, text string")
    renamed = names.replace("Anna", "Zoe").replace("Ben", "Carl").replace("5", "17").replace("3", "4")
    rows = [(1, "Question: " + short), (2, "x. " + short), (3, short.lower()), (4, short.upper()), (5, "Question: " + other), (6, "see: " + other.lower() + "."), (7, "They say " + other.upper()),
            (8, "Q: " + renamed), (9, renamed.replace("Zoe have", "Carl have")), (10, "please " + names.lower()), (11, "How many legs do spiders have in all?"), (12, "Question: Name the four winds"),
            (13, "Many Legs Do Nine Other Things Have In Some Total Or None")]
    got = {(r.doc_id, r.item_id): r.exact for r in templates.leaking_rows(frame(spark, rows), bench).collect()}
    assert got == {**{(k, 1): True for k in (1, 2, 3, 4)}, **{(k, 2): True for k in (5, 6, 7)}, (8, 3): False, (10, 3): True, (12, 4): True}


def test_template_joins_beyond_the_broadcast(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, templates.leaking_rows(docs, bench).collect()))
    monkeypatch.setattr(templates, "BROADCAST_ROWS", 0)
    assert want and sorted(map(tuple, templates.leaking_rows(docs, bench).collect())) == want


@pytest.mark.parametrize("n", [4, 5, 6, 7, 8])
def test_window_hashes_tell_windows_apart(spark, n):
    rng = random.Random(n)
    words = [rng.choice("abc") for _ in range(60)]
    rows = spark.createDataFrame([(words,), (words[:n],), (words[: n - 1],), ([],)], "w array<string>").select(templates._hashes(F.col("w"), n, True).alias("h")).collect()
    windows = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
    assert len(rows[0].h) == len(windows) and len(rows[1].h) == 1 and rows[1].h[0] == rows[0].h[0] and rows[2].h == rows[3].h == []
    assert len(set(rows[0].h)) == len(set(windows)) and len(set(zip(rows[0].h, windows))) == len(set(windows))


def plain_ftrl(rows, passes):
    """FTRL-proximal as published, a coordinate at a time, over (set of features, label) rows."""
    import math

    seen = {}
    for found, _ in rows:
        for f in found:
            seen[f] = seen.get(f, 0) + 1
    z, n = {f: 0.0 for f, k in seen.items() if k >= toxicity.SEEN}, {}
    bias = [0.0, 0.0]

    def weight(f):
        if abs(z[f]) <= toxicity.L1:
            return 0.0
        return -(z[f] - math.copysign(toxicity.L1, z[f])) / ((toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(passes):
        for found, label in rows:
            w = {f: weight(f) for f in found if f in z}
            b = -bias[0] / ((toxicity.BETA + math.sqrt(bias[1])) / toxicity.ALPHA)
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + b)))) - label
            for f, value in w.items():
                rate = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA
                z[f] += g - rate * value
                n[f] = n.get(f, 0.0) + g * g
            bias[0] += g - (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / toxicity.ALPHA * b
            bias[1] += g * g
    return z, n, bias


def test_ftrl_equals_the_plain_one():
    rng = random.Random(12)
    rows = [(np.unique(np.array([rng.randrange(40) for _ in range(rng.randrange(12))] + ([50] if k % 3 == 0 else []), dtype=np.uint32)), int(k % 3 == 0)) for k in range(150)]
    state = toxicity.train(rows, toxicity.State(), 3)
    z, n, bias = plain_ftrl([(r.tolist(), y) for r, y in rows], 3)
    assert state.index.tolist() == sorted(z) and np.allclose(state.z, [z[f] for f in sorted(z)]) and np.allclose(state.n, [n.get(f, 0.0) for f in sorted(z)]) and np.allclose(state.bias, bias)
    assert toxicity.weights(state.z, state.n).any()


def test_mixing_counts_silent_shards():
    start = toxicity.State(np.array([3, 9], np.uint32), np.array([2.0, -4.0]), np.array([1.0, 5.0]), (1.0, 2.0))
    mixed = toxicity._mixed(start, np.array([-1, 3, 7]), np.array([8.0, 10.0, 6.0]), np.array([4.0, 3.0, 2.0]), np.array([4, 2, 1]), 4)
    assert mixed.index.tolist() == [3, 7] and mixed.z.tolist() == [(10 + 2 * 2) / 4, 6 / 4] and mixed.n.tolist() == [(3 + 2 * 1) / 4, 2 / 4] and mixed.bias == (2.0, 1.0)


def test_calibration_recovers_slope_and_offset():
    rng = np.random.default_rng(5)
    margin = rng.normal(0, 2, 20_000)
    label = (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * margin - 1)))).astype(int)
    assert np.allclose(toxicity.calibration(margin, label, np.ones(20_000)), (1.5, -1.0), atol=0.1)
    # Clean rows thinned to a quarter and weighed by four give the same.
    kept = (label == 1) | (rng.random(20_000) < 0.25)
    assert np.allclose(toxicity.calibration(margin[kept], label[kept], np.where(label[kept] == 1, 1.0, 4.0)), (1.5, -1.0), atol=0.15)
    assert toxicity.calibration(margin, np.zeros(20_000, int), np.ones(20_000)) == (1.0, 0.0)
    slope, _ = toxicity.calibration(np.array([-1.0, -2.0, 1.0, 2.0] * 10), np.array([0, 0, 1, 1] * 10), np.ones(40))
    assert 0 < slope < 50


def test_foreign_archives_are_read_whole(spark, tmp_path):
    import gzip

    def raw(kind, n, body):
        block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body if kind == "response" else body
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{n}>\r\nWARC-Target-URI: http://h/{n}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    rows = [("warcinfo", 0, b"software: other\r\n"), ("response", 1, b"one\r\n\r\ntwo"), ("response", 2, b"x" * 30_000), ("request", 3, b"GET /"), ("response", 4, b"")]
    folder = tmp_path / "foreign"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"".join(raw(*r) for r in rows))
    (folder / "b.warc.gz").write_bytes(b"".join(gzip.compress(raw(*r)) for r in rows))
    with gzip.GzipFile(folder / "c.warc.gz", "wb") as named:  # a member with a name
        named.write(raw(*rows[1]))
    (folder / "note.txt").write_text("not an archive")
    got = sorted((r.record_id, r.record_type, bytes(r.payload) if r.payload is not None else None) for r in warc.read_warc(spark, str(folder)).collect())
    each = [(f"<urn:x:{n}>", kind, body if kind == "response" else None) for kind, n, body in rows]
    assert got == sorted(each * 2 + [each[1]])
    assert warc.read_warc(spark, str(folder), payload=False).filter("record_type = 'response' AND target_uri = 'http://h/2'").count() == 2
    with gzip.open(folder / "d.warc.gz", "wb") as two:
        two.write(raw(*rows[1]) + raw(*rows[2]))
    with pytest.raises(Exception, match="more than one record"):
        warc.read_warc(spark, str(folder)).collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no WARC file"):
        warc.read_warc(spark, str(tmp_path / "none")).collect()


def test_shards_refuse_repeated_keys(spark, tmp_path):
    with pytest.raises(ValueError, match="unique"):
        sharding.write_shards(frame(spark, [(1, "a"), (1, "b")]), f"{tmp_path}/s")
    table = sharding.write_shards(frame(spark, [(1, "a"), (None, "b")]), f"{tmp_path}/t").collect()
    assert [(r.shard, r.shard_rows) for r in table] == [("", 2)] and {r._shard for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {"root"}


def test_only_rows_that_may_be_wanted_are_shuffled_for_their_sets(spark):
    """The rows whose sets are fetched are told by a bitmap before the join, so the texts of the others stay where they are."""
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("row"))
    wanted = rows.filter("id % 40 = 7").select(F.struct("row").alias("at"))
    bits = neardup._wanted_bits(wanted, "at.row")
    assert bits.nbytes == neardup.MAPPED // 8
    kept = {r["id"] for r in neardup._maybe_wanted(rows, "row", bits).collect()}
    assert {k for k in range(20_000) if k % 40 == 7} <= kept and len(kept) < 600
    assert neardup._maybe_wanted(rows, "row", neardup._wanted_bits(wanted.limit(0), "at.row")).count() == 0


def test_toxicity_scores_a_text_that_travels_once(spark):
    docs = spark.createDataFrame([(1, "you vile fool", "en"), (2, None, "de"), (3, "", "fr"), (4, "a calm word", "en")], "doc_id long, text string, lang string")
    index = np.unique(toxicity.features("you vile fool", toxicity.WordHashes()))
    model = toxicity.Model(index, np.full(len(index), 1.5), -2.0)
    scored = toxicity.score(docs, model)
    assert str(scored._jdf.queryExecution().analyzed()).count("cast(text") == 0
    found = {r["doc_id"]: (r["text"], r["lang"], r["toxicity"]) for r in scored.collect()}
    of = model.scorer()
    for r in docs.collect():
        assert found[r["doc_id"]] == (r["text"], r["lang"], of(toxicity.features(r["text"], toxicity.WordHashes())))
    as_bytes = toxicity.score(docs.withColumn("text", F.col("text").cast("binary")), model)
    assert {r["doc_id"]: r["toxicity"] for r in as_bytes.collect()} == {k: v[2] for k, v in found.items()}
