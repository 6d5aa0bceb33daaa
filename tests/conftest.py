import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FIXTURE_ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures", "gosrc")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("codecat-tests")
         .config("spark.driver.memory", "4g")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codecat-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def fixture_catalog(spark):
    from codecat.plans.catalog import build_catalog, read_source_tree
    files = read_source_tree(spark, FIXTURE_ROOT)
    ext = spark.createDataFrame(
        [("sync", "Mutex", "Lock", True, "func (m *sync.Mutex) Lock()", "()()"),
         ("sync", "Mutex", "TryLock", True, "func (m *sync.Mutex) TryLock() bool", "()(bool)"),
         ("sync", "Mutex", "Unlock", True, "func (m *sync.Mutex) Unlock()", "()()")],
        "package string, type_name string, name string, ptr_receiver boolean, signature string, sig_key string")
    cat, rejects = build_catalog(spark, files, ext)
    # Materialise once for the whole session (tests only; the library never caches).
    cat = cat.with_(**{n: getattr(cat, n).cache() for n in
                       ("packages", "funcs", "types", "methods", "vars", "fields", "embeds")})
    return cat, rejects.cache()
