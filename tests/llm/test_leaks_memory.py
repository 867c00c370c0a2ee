import numpy as np
from pyspark import SparkContext

from ridgeloom.llm import leaks


def test_products_send_few_columns_and_let_go_of_them(spark, monkeypatch):
    sent = []

    def broadcast(self, value, plain=SparkContext.broadcast):
        out = plain(self, value)
        destroy = out.destroy
        sent.append([value[1].shape[1], False])
        out.destroy = lambda blocking=False, k=len(sent) - 1: (sent[k].__setitem__(1, True), destroy(blocking))
        return out

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    rng = np.random.default_rng(3)
    terms = [rng.integers(0, 700, 24).tolist() for _ in range(90)]
    idf, x = rng.random(700) + 0.1, rng.standard_normal((700, 2 * leaks.COLUMNS + 5))
    got = leaks._gram_product(spark.createDataFrame([(t,) for t in terms], "terms array<bigint>").repartition(3), idf, x)
    a = np.zeros((len(terms), 700))
    for i, t in enumerate(terms):
        np.add.at(a[i], t, leaks._row(np.array(t), idf))
    assert np.allclose(got, a.T @ (a @ x), rtol=1e-9, atol=1e-12)
    assert sent == [[leaks.COLUMNS, True], [leaks.COLUMNS, True], [5, True]]  # before: all columns, in a closure that stayed
