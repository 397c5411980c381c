"""Disc ids by hand, also of times that take more than eight digits, as printf's %08x has them."""

from reelbase.operators import discs as D


def expected(starts):
    digits = sum(int(x) for s in starts[:-1] for x in str(s))
    return f"{(digits % 255 << 24) + (starts[-1] - starts[0] << 8) + len(starts) - 1:08x}"


def test_long_and_short_numbers_keep_all_digits(spark):
    discs = {1: [2, 190, 3605], 2: [0, 1], 3: [999_999_999, 9_999_999_999, 99_999_999_999, 100_000_600_000], 4: [299_999_999_999_999] * 2 + [300_000_000_000_000], 5: [7]}
    rows = [(d, n, s) for d, starts in discs.items() for n, s in enumerate(starts)]
    got = {r.disc: (r.disc_id, r.n_tracks) for r in D.disc_ids(spark.createDataFrame(rows, "disc long, track long, start long")).collect()}
    assert got == {d: (expected(s), len(s) - 1) for d, s in discs.items() if len(s) > 1}
    assert len(got[2][0]) == 8 and max(len(x) for x, _ in got.values()) > 8
