"""The streaming forms give the same answers as the batch plans."""

import tempfile

from pyspark.sql import functions as F

from tessera.operators import performance as P
from tessera.sources import views as V
from tessera.streaming import flows as SP


def test_performance_index_stream_matches_batch(spark, sf):
    table = P.weight_table(V.texture_weights(spark))
    arrays = P.day_arrays(V.foam_long(spark, sf))
    src = tempfile.mkdtemp(prefix="tessera-stream-src-")
    arrays.write.mode("overwrite").parquet(src)
    q = SP.start(SP.performance_index_stream(spark, src, table), "pi_stream", tempfile.mkdtemp(prefix="tessera-ck-"))
    q.processAllAvailable()
    got = {r["id"]: r["performance_index"] for r in spark.sql("select * from pi_stream").collect()}
    q.stop()
    want = {r["id"]: r["performance_index"] for r in
            P.performance_index(V.foam_long(spark, sf), V.texture_weights(spark)).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert (got[k] is None and want[k] is None) or abs(got[k] - want[k]) < 1e-6


def test_stability_stream_matches_batch(spark, sf):
    obs = V.obs_long(spark, sf)
    src = tempfile.mkdtemp(prefix="tessera-stream-obs-")
    obs.write.mode("overwrite").parquet(src)
    q = SP.start(SP.stability_stream(spark, src), "stab_stream", tempfile.mkdtemp(prefix="tessera-ck-"), mode="complete")
    q.processAllAvailable()
    got = sorted(tuple(r) for r in spark.sql("select * from stab_stream").collect())
    q.stop()
    from tessera.operators import stability as S
    want = sorted(tuple(r) for r in S.stability(obs).collect())
    assert got == want
