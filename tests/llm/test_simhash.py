import random

import xxhash

from graphloom.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    root = {d: d for d, _ in fps}
    changed = True
    while changed:
        changed = False
        for a, x in fps:
            for b, y in fps:
                if (x ^ y).bit_count() <= radius and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_edge_rows_against_brute_force(odd_docs):
    rows = odd_docs.collect()
    got = simhash.near_duplicates(odd_docs).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in got) == sorted((str(r.doc_id), plain_fingerprint(r.text)) for r in rows)
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows if r.doc_id is not None])
    own = {}
    for r in got:
        own.setdefault(r.doc_id, set()).add(r.component_id)
    assert own.pop(None) == {None}
    assert {d: min(c) for d, c in own.items()} == want or all(want[d] in c for d, c in own.items())


def test_links_in_small_tiles(spark):
    random.seed(2)
    base = [random.getrandbits(64) for _ in range(12)]
    fps = {x ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) for x in base for _ in range(40)}
    fps = list(enumerate(sorted(f % 2**64 for f in fps)))
    points = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in fps], "fp long, rep long")
    for blocks, tile in ((5, 1024), (7, 3)):
        links = simhash.near_links(points, 4, blocks, tile).collect()
        parts = simhash.connected_components(spark.createDataFrame(links, "u long, v long"))
        got = {i: i for i, _ in fps} | {r.node: r.component for r in parts.collect()}
        assert got == plain_components(fps)


def test_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r.component for r in simhash.connected_components(chain).collect()} == {0}


def test_one_of_each_keeps_columns(odd_docs, no_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert ids.count(None) == 2 and 0 in ids and 1 not in ids and 6 in ids and 7 not in ids
    assert simhash.one_of_each(no_docs).count() == 0
