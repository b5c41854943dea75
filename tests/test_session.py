import os
import types

import pytest

from lorewell import session


def _unset(master):
    """A session without a checkpoint folder on some master."""
    context = types.SimpleNamespace(master=master, _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isEmpty=lambda: True))))
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda name, default: default), sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,3000]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_folder(_unset(master))


def test_masters():
    assert session.is_local("local[*]") and session.is_local("local") and session.is_local("local[4, 2]")
    assert not session.is_local("local-cluster[1,1,1024]")


def test_scratch_is_emptied(spark, data):
    from lorewell.plans import catalogue

    session.release(spark)
    assert catalogue.QUERIES["component_sizes"](spark, data).count() > 0
    folders = set(session._open[spark.sparkContext.applicationId])
    local = [f.removeprefix("file:") for f in folders]
    assert folders and all(map(os.path.isdir, local))
    assert session.release(spark) == len(folders) and not any(map(os.path.exists, local)) and session.release(spark) == 0
    scratch = session.Scratch(spark)
    saved = scratch.save(spark.range(3))
    assert saved.count() == 3
    scratch.close()
    assert not os.path.exists(scratch.folder.removeprefix("file:")) and session.release(spark) == 0
