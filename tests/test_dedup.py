"""Near-duplicates against brute force."""

from collections import Counter

from threatloom.operators import dedup

TOP = -(1 << 63)


def test_near_duplicates_equal_brute_force(spark):
    base = 0x5A5A_0F0F_3C3C_1110
    hashes = [base, base, base, base ^ (7 << 20), base ^ (7 << 20), base ^ (15 << 20), base ^ 1, base ^ (1 << 40) ^ (1 << 59), TOP, TOP, TOP ^ (1 << 33), 0, -16, -16]
    frame = spark.createDataFrame(list(enumerate(hashes, 10)), "article_id long, simhash long")
    found = dedup.near_duplicates(frame).collect()
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    close = {(i, j) for i, a in enumerate(hashes, 10) for j, b in enumerate(hashes, 10) if i < j and a & 15 == b & 15 and apart(a, b) <= 3}
    by_id, size = dict(enumerate(hashes, 10)), Counter(hashes)
    assert len(found) == len({(r.id_a, r.id_b) for r in found})
    for r in found:
        assert tuple(sorted((r.id_a, r.id_b))) in close and r.distance == apart(by_id[r.id_a], by_id[r.id_b])
        assert (r.n_a, r.n_b) == (size[by_id[r.id_a]], size[by_id[r.id_b]])
    # What the links say about all articles: those of one first article, or of two linked ones.
    first = {i: i for i in by_id} | {r.id_b: r.id_a for r in found if r.distance == 0}
    linked = {frozenset((r.id_a, r.id_b)) for r in found if r.distance}
    assert close == {(i, j) for i in by_id for j in by_id if i < j and (first[i] == first[j] or frozenset((first[i], first[j])) in linked)}
    assert dedup.near_duplicates(frame.where("false")).count() == 0
