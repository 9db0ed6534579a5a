import pytest

from picotick.plans import stages


def test_only_what_changed_is_made_again(spark, tmp_path):
    def run(n, k):
        return stages.StageRun(spark, str(tmp_path), [
            stages.Stage("a", lambda n: spark.range(n), settings={"n": n}),
            stages.Stage("b", lambda a, k: a.selectExpr(f"id * {k} AS x"), needs=("a",), settings={"k": k})])

    first = run(3, 2)
    assert sorted(r.x for r in first.table("b").collect()) == [0, 2, 4] and first.made == ["a", "b"]
    again = run(3, 2)
    again.table("b")
    assert again.made == []
    later = run(3, 5)
    assert sorted(r.x for r in later.table("b").collect()) == [0, 5, 10] and later.made == ["b"]
    earlier = run(4, 5)
    earlier.table("b")
    assert earlier.made == ["a", "b"]


def test_sweep_and_plan():
    every = stages.sweep({"mode": ["d", "s"], "window": [1, 2]}, [{"mode": "s", "window": 2}])
    assert every == [{"mode": "d", "window": 1}, {"mode": "d", "window": 2}, {"mode": "s", "window": 1}]
    done = {stages.signature(every[0])}
    assert [s for _, s in stages.plan(every, done, {stages.signature(every[1])})] == ["keep", "resume", "run"]


def test_one_failure_does_not_stop_the_others():
    def run(n):
        if n == "b":
            raise ValueError("no")
        return n

    done, failed = stages.each_isolated(["a", "b", "c"], run)
    assert done == {"a": "a", "c": "c"} and failed == {"b": "ValueError: no"}


def test_registry():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and "agg_f1_fwhm" in names
    with pytest.raises(ValueError, match="twice"):
        from picotick.plans.registry import register

        register("agg_f1_fwhm")(lambda *a: None)
