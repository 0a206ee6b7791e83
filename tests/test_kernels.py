"""Kernels that SQL can't follow, against plain Python."""

import numpy as np
import pytest

from lumenfold.operators import blockmath, grain


def filled(seed, weights, lag, shift, scale, noise, luma=None):
    """A table of grain, entry by entry."""
    state, out = seed, [[0] * 82 for _ in range(73)]
    for y in range(73):
        for x in range(82):
            state = state >> 1 | ((state ^ state >> 1 ^ state >> 3 ^ state >> 12) & 1) << 15
            out[y][x] = int(noise[state >> 5]) + (1 << 3 + scale) >> 4 + scale
    for y in range(3, 73):
        for x in range(3, 79):
            total, k = 0, 0
            for dy in range(-lag, 1):
                for dx in range(-lag, lag + 1):
                    if dy == 0 and dx == 0:
                        break
                    total += weights[k] * out[y + dy][x + dx]
                    k += 1
            if luma is not None:
                total += weights[k] * luma[y][x]
            out[y][x] = max(-128, min(127, out[y][x] + (total + (1 << shift - 1) >> shift)))
    return out


@pytest.mark.parametrize("lag", [0, 1, 2, 3])
def test_grain_tables(spark, lag):
    rows = [(k, 40503 * k % 65536, [(k * 7 + i * 5) % 25 - 12 for i in range(2 * lag * (lag + 1) + 1)]) for k in range(1, 4)]
    got = {(r["key"], r["plane"]): r["grain"] for r in grain.tables_of(spark.createDataFrame(rows, "key long, seed long, weights array<long>"), lag).collect()}
    noise = grain.normal_noise()
    for key, seed, weights in rows:
        luma = filled(seed, weights, lag, 7, 0, noise)
        for plane, want in enumerate([luma, filled(seed ^ 0xB524, weights, lag, 7, 0, noise, luma), filled(seed ^ 0x49D8, weights, lag, 7, 0, noise, luma)]):
            assert got[key, plane] == [v for line in want for v in line]
    assert len(got) == 9


def test_grain_lines_are_made_where_tables_are(spark, tmp_path):
    """One file is dealt to all cores, equal keys add up, and no entry of a table becomes a row."""
    from lumenfold import registry

    spark.range(1, 1101).selectExpr("explode(if(id = 7, array(id, id, id), array(id))) AS s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    made = registry.queries()["grain_luts"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.index("MapInArrow") < plan.index("REPARTITION_BY_NUM")
    assert made.rdd.getNumPartitions() > 4
    got = {(r["key"], r["plane"], r["y"]): (r["total"], r["least"], r["most"]) for r in made.collect()}
    noise = grain.normal_noise()
    assert len(got) == 1100 * 3 * 73
    for key, times in ((1, 1), (7, 3), (1100, 1)):
        seed, weights = 40503 * key % 65536, [(key * 7 + i * 5) % 25 - 12 for i in range(13)]
        luma = filled(seed, weights, 2, 7, 0, noise)
        for plane, want in enumerate([luma, *[filled(seed ^ turn, weights, 2, 7, 0, noise, luma) for turn in grain.CHROMA_SEEDS]]):
            assert [got[key, plane, y] for y in range(73)] == [(times * sum(line), min(line), max(line)) for line in want]


def test_draws_by_place_in_the_round():
    """Every seed of 16 bits, zero among them, and a negative one."""
    entries = grain.normal_noise()
    n = grain.HEIGHT * grain.GRAIN_WIDTH
    assert len(set(grain._register(n)[1])) == 1 << 16
    for seeds in (np.array([0, 1, 2, 40503, 32768, 65535]), np.array([5, -3])):
        assert (grain._drawn(seeds, entries).reshape(n, -1) == entries[grain._draws(seeds, n)]).all()


@pytest.mark.parametrize("size", [1, 30, 1000, 10**6, 10**9])
def test_grain_of_heavy_weights(size):
    """Sums that need two, four or eight bytes."""
    seeds, weights, noise = np.array([5, 9]), np.array([(i * 7 % 11 - 5) * size for i in range(26)]).reshape(13, 2), grain.normal_noise()
    luma = grain.grain_tables(seeds, weights, 2, 9, 1, noise)
    chroma = grain.grain_tables(seeds + 1, weights, 2, 9, 1, noise, luma)
    for i in range(2):
        own = [int(w) for w in weights[:, i]]
        assert luma[:, :, i].tolist() == filled(int(seeds[i]), own, 2, 9, 1, noise)
        assert chroma[:, :, i].tolist() == filled(int(seeds[i]) + 1, own, 2, 9, 1, noise, luma[:, :, i].tolist())


@pytest.mark.parametrize("n", [4, 8, 16, 32])
def test_cosine_matrix_is_nearly_orthogonal(n):
    m = blockmath.cosine_matrix(n)
    product = m.T @ m
    assert np.allclose(np.diag(product), n * 4096, rtol=0.02) and np.abs(product - np.diag(np.diag(product))).max() < 0.02 * n * 4096
    assert (m[:, 0] == 64).all()


def test_flat_blocks_stay_flat():
    """A constant block under any angle, phase or refinement."""
    flat = np.full((5, 64), 77)
    assert (blockmath.sub_sample(flat, np.arange(5) * 3, np.arange(5) * 2) == 77).all()
    edges, steps = np.full((4, 33), 200), np.array([1, 64, 1000, 4096])
    assert all((x == 200).all() for x in blockmath.directional(edges, steps, steps[::-1]))
    dy, dx = blockmath.refine(flat, flat, np.ones(5, np.int64))
    assert not dy.any() and not dx.any()
