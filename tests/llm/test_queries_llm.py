"""The registered text queries and the pipeline against plain versions, oracles and held-out labels."""

import base64
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from cohortlens.llm import queries as q
from cohortlens.llm.common import read_table, stage
from tests.conftest import SF001, SF0001
from tests.llm import brute


def rows_of(sf, table):
    return duckdb.sql(f"SELECT * FROM '{sf}/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r for r in rows_of(SF0001, "documents")}


def test_every_operator_has_one_query():
    names = list(q.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(q.oracle_sql()) <= set(names)


def test_simhash_query(spark, texts):
    ids = sorted(texts)
    prints = [brute.simhash(texts[i][1]) for i in ids]
    want = {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, brute.classes(prints), strict=True)}
    got = q.op1_simhash_near_dedup(spark, SF0001).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def test_mixing_query(spark):
    docs = {r[0]: r for r in rows_of(SF001, "documents")}
    sizes = Counter()
    for r in docs.values():
        sizes[r[3]] += len(brute.words(r[1]))
    want, taken = brute.targets(sizes), Counter()
    for r in q.op2_mix_sources(spark, SF001).collect():
        source = docs[r.doc_id][3]
        assert r["size"] == len(brute.words(docs[r.doc_id][1])) and r.taken <= 3 * r["size"]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        taken[source] += r.taken
    assert all(abs(taken[s] - t) <= 100 and abs(taken[s] - t) <= 0.05 * t for s, t in want.items())


def test_neighbours_query(spark):
    rows = sorted(rows_of(SF001, "embeddings"))
    ids, v = [r[0] for r in rows], [r[1] for r in rows]
    got = defaultdict(list)
    for r in q.op3_nearest_neighbours(spark, SF001).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    found = total = 0
    for i in range(0, len(ids), 50):
        want = brute.nearest(ids, v, i)
        found, total = found + len(set(want) & {x for _, x in got[ids[i]]}), total + len(want)
    assert len(got) == len(range(0, len(ids), 50)) and found >= 0.9 * total


def test_fingerprint_query(spark):
    docs = [(r[0], r[1]) for r in sorted(rows_of(SF001, "documents"))]
    got = {r.doc_id: r for r in q.op5_document_fingerprints(spark, SF001).collect()}
    errors = []
    for n, (i, t) in enumerate(docs):
        after, k = docs[(n + 1) % len(docs)][1], len(t) // 4
        edited = t[:len(t) - k] + after[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), brute.sha(edited))
        errors.append(abs(got[i].near_edited - brute.jaccard(brute.shingles(t), brute.shingles(edited))))
        assert abs(got[i].near_next - brute.jaccard(brute.shingles(t), brute.shingles(after))) <= 0.1
    assert np.mean(errors) < 0.03
    same = defaultdict(set)
    for i, t in docs:
        same[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())


def encoding():
    with open(q.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, texts):
    plain = encoding()
    for r in q.op6_byte_bpe(spark, SF0001).collect():
        ids = plain.encode_ordinary(texts[r.doc_id][1])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), brute.sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == brute.sha(texts[r.doc_id][1])


def test_substring_query(spark, texts):
    ids = sorted(texts)
    want = dict(zip(ids, brute.without_repeats([texts[i][1] for i in ids]), strict=True))
    got = q.op7_substring_dedup(spark, SF0001).collect()
    assert len(got) == len(ids)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == (*want[r.doc_id][:2], brute.sha(want[r.doc_id][2]))


def test_language_query(spark):
    lang = {r[0]: r[2] for r in rows_of(SF001, "documents")}
    got = q.op8_language_id(spark, SF001).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97


def test_toxicity_query(spark):
    toxic = {r[0]: r[2] for r in rows_of(SF001, "labels")}
    got = q.op9_toxicity(spark, SF001).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) >= 0.9
    assert np.mean([r.predicted for r in held if not toxic[r.doc_id]]) <= 0.05


def test_license_query_equals_its_oracle(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF001}/documents.parquet'")
    want = sorted(con.sql(q.oracle_sql()["op10_license_scan"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in q.op10_license_scan(spark, SF001).collect()), key=str) == want


def test_pipeline(spark):
    texts = {r[0]: r for r in rows_of(SF001, "documents")}
    docs = read_table(spark, SF001, "documents")
    columns, found = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF001), name)
        found[name] = docs.collect()
        assert name == "byte_bpe" or docs.columns == columns
    clean = sorted(r.doc_id for r in found["toxicity"])
    marked = {r[0]: r[2] for r in rows_of(SF001, "labels")}  # some of the documents
    toxic, fair = ({i for i in texts if marked.get(i) == kind} for kind in (1, 0))
    assert 0.8 * len(texts) <= len(clean) < len(texts)
    assert len(fair - set(clean)) <= 0.01 * len(fair) and len(toxic.intersection(clean)) < 0.5 * len(toxic)
    roots = brute.classes([brute.simhash(texts[i][1]) for i in clean])
    kept = sorted({clean[r] for r in roots})
    assert sorted(r.doc_id for r in found["simhash_near_dedup"]) == kept
    cut = dict(zip(kept, brute.without_repeats([texts[i][1] for i in kept]), strict=True))
    for r in found["substring_dedup"]:
        text = cut[r.doc_id][2] if cut[r.doc_id][1] else texts[r.doc_id][1]
        assert (r.text, r.n_chars) == (text, len(text))
    sizes, taken = Counter(), Counter()
    for r in found["substring_dedup"]:
        sizes[r.source] += len(brute.words(r.text))
    for r in found["mix_sources"]:
        taken[r.source] += len(brute.words(r.text))
    assert all(abs(taken[s] - t) <= 100 for s, t in brute.targets(sizes).items())
    plain = encoding()
    want = Counter((r.doc_id, tuple(plain.encode_ordinary(r.text or ""))) for r in found["mix_sources"])
    assert Counter((r.doc_id, tuple(r.ids)) for r in found["byte_bpe"]) == want
    assert all(r.round_trip for r in found["byte_bpe"])


def test_pipeline_run_gives_the_same(spark):
    a = corpus_pipeline.run(spark, SF0001).select("doc_id", "n_tokens")
    assert a.count() > 0 and a.columns == ["doc_id", "n_tokens"]
