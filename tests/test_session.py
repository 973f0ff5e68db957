from quakes.session import SESSION_CONF, checkpoint_dir, path_exists, table_dir


def test_checkpoint_dir_comes_from_the_session(spark):
    d = checkpoint_dir(spark)
    assert d == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    t = table_dir(spark, "/some/data", "eq_data")
    assert t.startswith(d + "/quakes-tables/" + spark.sparkContext.applicationId + "/eq_data-")
    assert table_dir(spark, "/other/data", "eq_data") != t


def test_runtime_settings_applied(spark):
    for k, v in SESSION_CONF.items():
        assert spark.conf.get(k) == v, k
    assert spark.conf.get("spark.ui.enabled") == "false"


def test_path_exists(spark, tmp_dir):
    assert path_exists(spark, tmp_dir)
    assert not path_exists(spark, tmp_dir + "/missing")
