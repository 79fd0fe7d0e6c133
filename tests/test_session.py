"""Where intermediates go, and when they go away."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from grantlens.session import Stages, checkpoint_dir


def pretended(master, named=None):
    conf = SimpleNamespace(get=lambda key, default=None: named if key == "spark.checkpoint.dir" else default)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(pretended(master))
    assert checkpoint_dir(pretended(master, "s3a://bucket/shared")) == "s3a://bucket/shared"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_a_local_session_may_do_without(master):
    assert Path(checkpoint_dir(pretended(master))).is_dir()


def test_stages_are_deleted_by_their_owner(spark):
    with Stages(spark) as stages:
        df = stages.add(spark.range(5))
        assert df.count() == 5
        path = Path(stages.paths[0].removeprefix("file:"))
        assert path.is_dir()
    assert not path.exists()
