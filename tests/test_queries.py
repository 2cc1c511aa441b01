import pytest
from conftest import DATA
from compare import clone_groups, rows

from gritmill.plans import code, core, more, repository  # noqa: F401


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, DATA).toPandas(), duck.sql(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(e.queries())


def test_token_clones_against_brute_force(spark, duck):
    ops = "+-*/%&|^"
    files = {}
    for k, n in duck.sql("SELECT p_partkey, p_size FROM part").fetchall():
        name = f"v{k}" if k % 2 == 0 else "vw"
        raws = [t for i in range(1, 13) for t in (name, "=", "a", ops[(n * (i * 3 + 1) + i * i) % 8], "b", ops[(n * (i * 5 + 1) + i * i) % 8], "7", ";")]
        kind = lambda t: "identifier" if t[0].isalpha() else "literal" if t.isdigit() else "delimiter" if t == ";" else "operator"
        files[f"src/p{k}.js"] = [("$ID" if t[0].isalpha() else t, t, kind(t), i // 8 + 1, i // 8 + 1) for i, t in enumerate(raws)]
    want = [(kind, n, len(at), max(b - a + 1 for _, a, b in at), len({p for p, _, _ in at}) == 1) for kind, n, at in clone_groups(files, 40, 4)]
    got = [(r.type, r.token_count, r.instances, r.line_count, r.is_intra_file) for r in core.QUERIES["token_clones"](spark, DATA).collect()]
    assert sorted(got) == sorted(want) and got
