from tallyweave.sources.feeds import load_disputes
from tallyweave.streaming.ingest import ingest_disputes, ingested


def content(df):
    kept = ["psp_reference", "record_type", "dispute_amount", "record_date", "source_file"]
    return sorted(tuple(r) for r in df.select(kept).collect())


def test_reruns_read_new_files_only(spark, tmp_path):
    folder, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "jan.csv").write_text(
        "Record Type,Psp Reference,Dispute Amount,Record Date\nChargeback,R1,1.50,2025-01-02\nSettled,R2,2,2025-01-02\n")
    (folder / "feb.csv").write_text(
        "Record Type;Psp Reference;Dispute Amount;Record Date\nChargeback;R3;3;02/02/2025\n")
    (folder / "~$feb.csv").write_text("lock")

    def rerun():
        query = ingest_disputes(spark, str(folder), target, state, files_per_batch=1)
        query.awaitTermination()
        assert query.exception() is None

    rerun()
    assert content(ingested(spark, target)) == content(load_disputes(spark, str(folder)))
    rerun()
    assert ingested(spark, target).count() == 2
    (folder / "mar.csv").write_text(
        "Psp Reference,Record Type,Dispute Amount,Record Date,Extra\nR4,NotificationOfChargeback,4,2025-03-01,x\n")
    rerun()
    assert content(ingested(spark, target)) == content(load_disputes(spark, str(folder)))
    assert ingested(spark, target).count() == 3
