from siteloom.sources.header import parse_header
from siteloom.streaming import arriving
from tests.test_sources import TEXT


def test_shards_are_read_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    header = parse_header([x for x in TEXT.splitlines() if x.startswith("#")])
    (folder / "a.vcf").write_text(TEXT)

    def run():
        sites = arriving.arriving_sites(spark, str(folder), header)
        q = arriving.append_to_table(arriving.passing(sites, 'QUAL>5 | INFO/DP=5').drop("arrived"), out, state)
        q.awaitTermination()

    run()
    assert spark.read.parquet(out).count() == 4
    run()
    assert spark.read.parquet(out).count() == 4
    (folder / "b.vcf").write_text(TEXT.replace("\t20\t", "\t21\t"))
    run()
    got = spark.read.parquet(out)
    assert got.count() == 8 and got.where("pos = 21").count() == 1
