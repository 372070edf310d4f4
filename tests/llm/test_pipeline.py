"""Stages of the corpus pipeline on small tables with nulls, empty, long and repeated texts, ties and extra columns."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _key string"
WORDS = {"en": "the house and garden with other people who were there before they went home again".split(), "de": "das haus und der garten mit anderen leuten die dort waren bevor sie wieder gingen".split()}


def _text(r, lang, n=60):
    return " ".join(r.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    r = np.random.default_rng(11)
    rows = []
    for k in range(120):
        lang = "en" if k % 2 else "de"
        t = _text(r, lang) + (" nasty vile" if k % 5 == 0 else "")
        rows.append((k, t, lang, f"host{k % 3}"))
    copy = _text(r, "en", 80)
    rows += [(200, copy, "en", "h"), (201, copy, "en", "h"), (202, copy + " more", "en", "h"), (203, "12345 67", "en", "h"), (204, None, "en", "h"), (205, "", None, None), (None, _text(r, "de"), "de", None), (206, _text(r, "en", 3000), "en", "h"), (207, "дом сад река поле мост где никто не жил давно", None, None)]
    again = (208, _text(r, "de"), "de", "h")
    rows += [again, again, (209, _text(r, "en"), "en", "h"), (209, _text(r, "de"), "de", "h")]
    folder = str(tmp_path_factory.mktemp("world"))
    docs = spark.createDataFrame([(*x, len(x[1] or ""), 0.5, "clash") for x in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 == 0), 1) for k in range(120)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet"), rows


def _ids(df):
    return sorted((x.doc_id is None, x.doc_id or 0) for x in df.collect())


def test_language_stage_drops_what_has_no_language(spark, world):
    folder, docs, rows = world
    kept = C.language_id(spark, docs, folder)
    gone = {203, 204, 205, 207}
    assert kept.columns == C.COLUMNS and _ids(kept) == sorted((i is None, i or 0) for i, *_ in rows if i not in gone)


def test_toxicity_stage(spark, world):
    folder, docs, rows = world
    kept = C.toxic(spark, docs, folder)
    ids = {x.doc_id for x in kept.collect()}
    toxic = {k for k in range(120) if k % 5 == 0}
    assert kept.columns == C.COLUMNS and not ids & toxic and len(ids & set(range(120))) >= 90 and {204, 205, None} <= ids
    assert C.toxic(spark, docs.limit(0), folder).count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark, world):
    folder, docs, rows = world
    kept = C.near_duplicates(spark, docs, folder)
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i, t] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    group = {k: k for k in sets}
    order = lambda k: (k[0] is not None, k[0] or 0)
    for _ in range(3):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b], key=order)
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted({group[k] for k in group}, key=str)
    assert kept.columns == C.COLUMNS and C.near_duplicates(spark, docs.limit(0), folder).count() == 0


def test_whole_run(spark, world):
    folder, _, rows = world
    pieces = C.run(spark, folder).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, *_ in rows}
    for p in pieces:
        if p.doc_id not in (209, None):
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    left = {p.doc_id for p in pieces}
    assert not left & {203, 204, 205, 207, 201, 202, 0, 5} and {200, 206, 208, 209, None} <= left
    assert sum(p.length for p in pieces if p.doc_id == 208) == len(ids[208])
