import math
import random

from lathework.llm.quality import STATISTICS, outlier_scores


def test_every_statistic_is_in_the_score(spark):
    """The score of all statistics against brute force, and documents that only those beside the deciding ones tell."""
    rnd = random.Random(21)
    value = lambda: None if rnd.random() < 0.05 else round(rnd.gauss(0.5, 0.1), 2)
    stats = [(i, "en" if i % 3 else "de", *[value() for _ in STATISTICS[:6]], round(rnd.random() ** 0.2, 2), round(rnd.random() ** 8, 2), 0.0) for i in range(400)]
    stats += [(400 + i, "en", *[[0.0, 1.0][i]] * 6, 1.0, 0.0, 0.0) for i in range(2)] + [(402, "en", 0.1, *[None] * 8)]
    frame = spark.createDataFrame(stats, "doc_id long, language string, " + ", ".join(f"{c} double" for c in STATISTICS))
    got = {r.doc_id: r for r in outlier_scores(frame).collect()}
    assert got.keys() == set(range(402))
    of, totals, deciding = {}, {}, {}
    for i, lang, *values in stats[:402]:
        reference = [v for _, o, *v in stats[:402] if o == lang and v[6] >= 0.5 and v[7] <= 0.5]
        sums, against = [0.0, 0.0, 0.0], 0.0
        for j, v in enumerate(values):
            if v is None:
                continue
            held = [r[j] for r in reference if r[j] is not None]
            mean = sum(held) / len(held)
            left, right = (-math.log(min((sum(t) + 1) / (len(held) + 1), 1)) for t in ([x <= v for x in held], [x >= v for x in held]))
            skewed = left if sum((x - mean) ** 3 for x in held) < -1e-9 * sum(abs(x) ** 3 for x in held) else right
            sums = [a + b for a, b in zip(sums, (left, right, skewed))]
            against += {6: left, 7: right, 8: right}.get(j, 0)
        of[i], totals[i], deciding[i] = lang, max(sums), against
    like = {i for i, _, *v in stats[:402] if v[6] >= 0.5 and v[7] <= 0.5}
    for i in totals:
        held = [totals[j] for j in like if of[j] == of[i]]
        joint = -math.log((sum(x >= totals[i] - 1e-9 for x in held) + 1) / (len(held) + 1))
        assert math.isclose(got[i].outlier_score, max(deciding[i], joint, 0.0), abs_tol=1e-9)
    assert all(got[i].outlier_score > math.log(got[i].reference_rows / 4) > deciding[i] for i in (400, 401))
