"""URL models larger than what goes to every task."""

import numpy as np
import pytest

from fluxloom.llm import urls


def test_models_too_large_for_a_task_judge_by_all_n_grams(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(3000):
        host = ("ham{}.example.net/en", "spam{}.example.com/de", "odd{}.test/xy", "ham{}.test/en", "spam{}.test/de")[k % 5].format(rng.integers(300))
        rows.append((k if k % 50 else None, f"http://{host}/{rng.integers(10**6)}/{'abcde'[k % 5] * (k % 30)}"))
    rows += [(1, rows[1][1]), (7, None), (8, ""), (9, "http://ham.test/" + "xyz" * 500)]
    pages = spark.createDataFrame(rows, "page_id int, url string")
    columns = ["page_id", "host", "path", "rule", "verdict", "score"]
    order = lambda found: sorted(map(tuple, found), key=lambda r: (r[1], r[2], r[0] or -1, r[5]))
    whole, limit = order(urls.judge(pages).select(columns).collect()), urls.fit(judged(pages)).limit
    sizes = []
    for entries in (3000, 300):  # 300: hardly more than the two short orders
        monkeypatch.setattr(urls, "ENTRIES", entries)
        model = urls.fit(judged(pages))
        assert model.limit == pytest.approx(limit, abs=1.5 * urls.GRAIN)
        sizes.append(model.rest.count())
        got = order(urls.judge(pages).select(columns).collect())
        assert [r[:4] for r in got] == [r[:4] for r in whole] and len(got) == len(rows)
        assert np.allclose([r[5] for r in got], [r[5] for r in whole], rtol=0, atol=1e-9)
        assert all(a[4] == b[4] for a, b in zip(got, whole, strict=True) if abs(b[5] - limit) > 2 * urls.GRAIN or b[3])
    assert 0 < sizes[0] < sizes[1]


def judged(pages):
    return urls.with_parts(pages).withColumn("r", urls.ruling()).select("url", "r.verdict")
