"""Pairs with the same common rows share their ranks."""

from supplylens.operators import stats


def test_ranks_are_shared_by_pairs_with_the_same_rows(rows, monkeypatch):
    data = [(float(k % 7), float(k * k % 11), float(k % 5) if k % 3 else None, float(-k) if k % 4 else None, None) for k in range(40)]
    runs = []
    plain = stats.running_totals
    monkeypatch.setattr(stats, "running_totals", lambda *a: runs.append(1) or plain(*a))
    got = {(r.left_field, r.right_field): (r.n, r.spearman) for r in stats.spearman(rows(data, "a double, b double, c double, d double, e double"), list("abcde")).collect()}
    assert len(runs) == 1 and len(got) == 6

    def ranks(values):
        return [sum(o < v for o in values) + (sum(o == v for o in values) + 1) / 2 for v in values]

    for (left, right), (n, found) in got.items():
        i, j = "abcde".index(left), "abcde".index(right)
        common = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
        x, y = (ranks(side) for side in zip(*common))
        mean = (n + 1) / 2
        want = sum((a - mean) * (b - mean) for a, b in zip(x, y)) / (sum((a - mean) ** 2 for a in x) * sum((b - mean) ** 2 for b in y)) ** 0.5
        assert n == len(common) and abs(found - want) < 1e-12
