from tessella.catalogue import QUERIES


def test_synonyms_of_all_customers(spark, tmp_path):
    spark.createDataFrame([(1, "CHINA"), (301, "FRANCE"), (90000, "CHIMA")], "c_custkey bigint, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(6, "FRANCE"), (18, "CHINA")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert {r.c_custkey: r.term for r in QUERIES["q_best_synonym"](spark, str(tmp_path)).collect()} == {1: 18, 301: 6, 90000: 18}


def test_sequences_of_all_parts(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (1, 21, 201, 301, 4000)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["q_seq_records"](spark, str(tmp_path)).collect()
    assert sorted((r.patent_id, r.seq_no) for r in got) == [("0", 1), ("1", 1), ("1", 2), ("1", 3), ("1", 4)]
    assert {r.residues for r in got} == {"RMFPA"}
