"""The versioned store: whole sets or none, pinned readers, kept tables that died half-way."""

import numpy as np
import pytest

from parlance.operators import linear as LN
from parlance.operators import store as ST
from parlance.plans import models as M
from parlance.sources import tables as TB
from tests.conftest import SF0001


def linear(names, value):
    return LN.LinearSet(("d",) * len(names), tuple(names), np.full((len(names), 4), value), np.full(len(names), value))


def test_versions_replace_whole_sets(spark, tmp_path):
    root = str(tmp_path / "store")
    assert ST.registry(spark, root) is None and ST.current(spark, root) is None
    ST.save_models(spark, [linear(["a", "b"], 1.0)], root)
    first = ST.current(spark, root)
    ST.save_models(spark, [linear(["b", "c"], 2.0)], root)
    now = ST.load_linear(spark, root)
    assert now.classifiers == ("b", "c") and (now.coefficients == 2.0).all()  # the removed model is gone
    pinned = ST.load_linear(spark, root, version=first)
    assert pinned.classifiers == ("a", "b") and (pinned.intercepts == 1.0).all()
    assert [n for n, _ in ST.versions(spark, root)] == [1, 2]


def test_a_save_that_dies_leaves_the_old_set(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    ST.save_models(spark, [linear(["a"], 1.0)], root)
    write, calls = LN.to_table, []

    def dies(s, models):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return write(s, models)

    monkeypatch.setattr(LN, "to_table", dies)
    with pytest.raises(OSError, match="lost"):
        ST.save_models(spark, [linear(["a"], 9.0), linear(["b"], 9.0)], root)
    assert ST.load_linear(spark, root).classifiers == ("a",) and ST.load_linear(spark, root).intercepts.tolist() == [1.0]
    ST.save_models(spark, [linear(["a"], 3.0)], root)
    assert ST.load_linear(spark, root).intercepts.tolist() == [3.0]


def test_prune(spark, tmp_path):
    root = str(tmp_path / "store")
    for v in (1.0, 2.0, 3.0):
        ST.save_models(spark, [linear(["a"], v)], root)
    assert len(ST.prune(spark, root, keep=1)) == 2
    assert ST.load_linear(spark, root).intercepts.tolist() == [3.0] and len(ST.versions(spark, root)) == 1


def test_sets_of_several_kinds(spark, tmp_path):
    root = str(tmp_path / "store")
    ST.save_models(spark, [M.domain_model(spark, SF0001), M.intent_models(spark, SF0001)], root)
    assert [t.kind for t in ST.load_models(spark, root)] == ["domain"]
    assert set(ST.load_linear(spark, root, domain="nba").domains) == {"nba"}
    assert len(ST.load_linear(spark, root)) == len(M.intent_models(spark, SF0001))


def test_a_kept_table_that_died_is_built_again(spark, tmp_path):
    for name in M.MODEL_TABLES:
        TB.read_table(spark, SF0001, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    sf = str(tmp_path)

    def dies():
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        M.kept_table(spark, sf, "numbers", dies)
    assert M.kept_table(spark, sf, "numbers", lambda: spark.range(5)).count() == 5
    assert M.kept_table(spark, sf, "numbers", dies).count() == 5  # published: not built again
    state = M.table_state(spark, sf)
    TB.read_table(spark, SF0001, "labels").limit(3).write.mode("overwrite").parquet(f"{sf}/labels.parquet")
    assert M.table_state(spark, sf) != state
