import os
from types import SimpleNamespace

import pytest

from tidewright.functions import workspace
from tidewright.functions.workspace import Workspace, delete, exists


def test_a_kept_table_is_read_again_and_dropped(spark):
    work = Workspace(spark, "test")
    kept = work.keep("numbers", spark.range(5))
    assert kept.count() == 5 and work.read("numbers", "id long").count() == 5 and exists(spark, work.path("numbers"))
    work.drop("numbers")
    assert not exists(spark, work.path("numbers"))
    work.drop("numbers")


def test_a_scope_removes_what_was_made_in_it(spark):
    outside = Workspace(spark, "outside")
    outside.keep("a", spark.range(1))
    with Workspace.scope():
        inside = Workspace(spark, "inside")
        inside.keep("b", spark.range(1))
        with pytest.raises(ZeroDivisionError), Workspace.scope():
            nested = Workspace(spark, "nested")
            nested.keep("c", spark.range(1))
            raise ZeroDivisionError
        assert not exists(spark, nested.root) and exists(spark, inside.root)
    assert not exists(spark, inside.root) and exists(spark, outside.root)
    delete(spark, outside.root)


def test_settings_are_as_before_and_shuffle_files_are_gone(spark, tmp_path):
    names = list(workspace._SETTINGS)
    before = [spark.conf.get(n, None) for n in names]
    folders = [f for top in os.listdir("/tmp") if top.startswith("blockmgr-") for f in [os.path.join("/tmp", top)]]
    files = lambda: {os.path.join(d, x) for f in folders for d, _, found in os.walk(f) for x in found if x.startswith("shuffle_")}
    held = files()
    workspace.write(spark.range(1000).repartition(4, "id"), str(tmp_path / "x"))
    assert [spark.conf.get(n, None) for n in names] == before and not files() - held
    with pytest.raises(Exception, match="(?i)exist"):
        workspace.write(spark.range(1), str(tmp_path / "x"), "error")
    assert [spark.conf.get(n, None) for n in names] == before


def test_a_cluster_must_name_its_shared_folder():
    unset = SimpleNamespace(get=lambda name, other=None: other)
    context = lambda master: SimpleNamespace(master=master, applicationId="app-1")
    with pytest.raises(ValueError):
        workspace.shared_folder(SimpleNamespace(conf=unset, sparkContext=context("spark://host:7077")))
    with pytest.raises(ValueError):
        workspace.shared_folder(SimpleNamespace(conf=unset, sparkContext=context("local-cluster[2,1,1024]")))
    assert workspace.shared_folder(SimpleNamespace(conf=unset, sparkContext=context("local[4]"))).endswith("tidewright-app-1")
