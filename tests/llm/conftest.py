import pytest


@pytest.fixture(scope="session")
def scratch(spark, tmp_path_factory):
    """A shared folder where the session names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return spark


@pytest.fixture()
def docs(scratch):
    """Documents with columns that clash with the operators' own names."""
    def make(rows):
        return scratch.createDataFrame(
            [(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_chars long, n_deleted string"
        )
    return make
