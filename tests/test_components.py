import random

from calltrace.operators import components


def test_settled_nodes_leave_the_rounds(spark, monkeypatch):
    real, written = components.materialize, []

    def counted(df, label):
        out = real(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(components, "materialize", counted)
    random.seed(5)
    chain = random.sample(range(10_000, 10_064), 64)
    edges = [(2 * i, 2 * i + 1) for i in range(1000)] + list(zip(chain, chain[1:], strict=False))
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: i - i % 2 for i in range(2000)} | dict.fromkeys(chain, 10_000)
    # what is written after the first round holds the chain's rest alone
    second = [i for i, (label, _) in enumerate(written) if label == "edges"][1]
    assert max(n for _, n in written[second:-1]) <= 64
    assert written[-1] == ("labels", 2064)
