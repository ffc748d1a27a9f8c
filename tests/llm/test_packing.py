import random

import numpy as np

from ponderloom.llm import packing


def plain_best_fit(sizes, length):
    rows = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(length - sum(sizes[i] for i in r), n) for n, r in enumerate(rows) if length - sum(sizes[i] for i in r) >= sizes[k]]
        if fits:
            rows[min(fits)[1]].append(k)
        else:
            rows.append([k])
    return rows


def test_best_fit_uses_the_least_room():
    for seed in range(30):
        rng = random.Random(seed)
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(1, 80))]
        mine, want = packing.best_fit_decreasing(sizes, 64), plain_best_fit(sizes, 64)
        assert sorted(k for r in mine for k in r) == list(range(len(sizes))) and all(sum(sizes[k] for k in r) <= 64 for r in mine)
        assert sorted(sum(sizes[k] for k in r) for r in mine) == sorted(sum(sizes[k] for k in r) for r in want)


def unpacked(rows, length):
    docs = {}
    for r in rows:
        ids, places = np.frombuffer(bytes(r.ids), "<u2"), np.frombuffer(bytes(r.positions), "<u2")
        assert len(ids) == length and r.lengths[0] == 0 and list(r.lengths) == sorted(r.lengths)
        for s, a, b in zip(r.segments, r.lengths, r.lengths[1:], strict=False):
            assert list(places[a:b]) == list(range(b - a))
            docs.setdefault(s.id, {})[s.start] = (ids[a:b], s.tokens)
    return {i: np.concatenate([p[0] for _, p in sorted(d.items())]) for i, d in docs.items()}


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = unpacked(packing.pack(docs, length=256, bundle_tokens=20_000).collect(), 256)
    encoding, size = packing._encoding(packing.default_ranks())
    for r in docs.collect():
        assert got[r.doc_id].tolist() == [*encoding.encode_ordinary(r.text), size]


def test_odd_rows(odd, no_rows):
    """Null ids and repeated rows included: each row's tokens are there once."""
    rows = packing.pack(odd, length=128).collect()
    encoding, size = packing._encoding(packing.default_ranks())
    want = {}
    for r in odd.collect():
        want.setdefault(r.doc_id, []).append(tuple([*encoding.encode_ordinary(r.text or ""), size]))
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        for s, a, b in zip(r.segments, r.lengths, r.lengths[1:], strict=False):
            pieces.setdefault((s.id, s.tokens), {}).setdefault(s.start, []).append(tuple(ids[a:b].tolist()))
    got = {}
    for (i, tokens), at in pieces.items():
        short = tokens <= 128
        texts = at[0] if short else [sum((p[0] for _, p in sorted(at.items())), ())]
        got.setdefault(i, []).extend(texts)
    assert {i: sorted(t) for i, t in got.items()} == {i: sorted(t) for i, t in want.items()} and len(want[5]) == 2 and len(want[None]) == 2
    assert packing.pack(no_rows).collect() == []


def test_written_matrices(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packing.write(packing.pack(docs, length=256), str(tmp_path / "p"))
    rows, meta = packing.read(spark, str(tmp_path / "p"))
    t = rows.toArrow()
    ids, places = (packing.matrix(t[c], meta["dtype"]) for c in meta["matrices"])
    assert ids.shape == places.shape == (rows.count(), 256)
    for k, ends in enumerate(t[meta["cumulative_lengths"]].to_pylist()):
        assert (places[k][ends[:-1]] == 0).all() and ends[-1] <= 256
