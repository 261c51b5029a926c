"""The shared scratch folder comes from the session."""

from cohortlens.session import SESSION_DEFAULTS, apply_defaults, new_work_path, work_dir


def test_work_dir_is_the_checkpoint_dir(spark):
    current = spark.sparkContext.getCheckpointDir()
    assert current and work_dir(spark) == current
    a, b = new_work_path(spark, "x"), new_work_path(spark, "x")
    assert a != b and a.startswith(current)


def test_defaults_applied(spark):
    apply_defaults(spark)
    for key, value in SESSION_DEFAULTS.items():
        assert spark.conf.get(key) == value
