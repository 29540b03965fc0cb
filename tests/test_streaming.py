import tempfile

from evalkit import fixtures as fx
from evalkit.streaming import scoring as ST
from tests.conftest import SF_SMALL


def test_stream_scores_like_batch(spark):
    d = tempfile.mkdtemp(prefix="evalkit-stream-")
    r = fx.responses(spark, SF_SMALL).select("event_id", "test", "context_length", "expected_tool",
                                              "expected_arg_key", "expected_arg_contains", "answer")
    r.repartition(3).write.json(d + "/in")
    q = ST.start_scoring(spark, d + "/in", d + "/out", d + "/ckpt", available_now=True)
    q.awaitTermination(300)
    got = {(x.event_id, x.score) for x in spark.read.parquet(d + "/out").select("event_id", "score").collect()}
    from evalkit.operators.summaries import score_responses
    want = {(x.event_id, x.score) for x in score_responses(r).select("event_id", "score").collect()}
    assert got == want and len(got) == r.count()
    s = ST.start_summary(spark, d + "/in", "evalkit_summary", d + "/ckpt2", available_now=True)
    s.awaitTermination(300)
    assert spark.table("evalkit_summary").count() == 10
