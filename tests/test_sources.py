"""CSV matrices in both orientations, labels, metadata, saved stages."""

from __future__ import annotations

import pytest
from conftest import GENES, GOLDEN, table
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallmat.functions import clean_names, header_names
from tallmat.operators import qc, shape
from tallmat.operators.axes import Axes
from tallmat.sources import export_csv, materialise, read_counts, read_metadata, read_table, write_table
from tallmat.sources.tables import write_bucketed


def entries(counts):
    return {(r["cell"], r["variable"]): r["value"] for r in counts.entries.collect()}


GOLDEN_ENTRIES = {(c, g): float(v) for c, values in GOLDEN.items() for g, v in zip(GENES, values)}


def golden_csv(quote=""):
    head = ",".join(f"{quote}{g}{quote}" for g in ["", *GENES])
    return "\n".join([head, *[f"{quote}{c}{quote}," + ",".join(map(str, v)) for c, v in GOLDEN.items()]]) + "\n"


def transposed_csv():
    head = ",".join(["gene", *GOLDEN])
    return "\n".join([head, *[g + "," + ",".join(str(v[i]) for v in GOLDEN.values()) for i, g in enumerate(GENES)]])


@pytest.mark.parametrize("quote", ["", '"'])
@pytest.mark.parametrize("quoted_body", [False, True])
def test_cells_by_genes(spark, tmp_path, quote, quoted_body):
    path = tmp_path / "m.csv"
    path.write_text(golden_csv(quote))
    counts = read_counts(spark, str(path), quoted_body=quoted_body)
    assert counts.entries.columns == ["cell", "variable", "value"]
    assert entries(counts) == GOLDEN_ENTRIES
    assert counts.wide().columns == ["cell", *sorted(GENES)]
    sparse = read_counts(spark, str(path), keep_zeros=False, quoted_body=quoted_body)
    assert entries(sparse) == {k: v for k, v in GOLDEN_ENTRIES.items() if v}
    assert table(sparse.wide(), "cell") == table(counts.wide(), "cell")
    assert table(qc.qc_cells(sparse.entries, sparse.implied()), "cell") == table(qc.qc_cells(counts.entries), "cell")
    assert qc.shape_counts(sparse.entries, sparse.axes).first() == (6, 5)


def test_genes_by_cells(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(transposed_csv())
    assert entries(read_counts(spark, str(path), "genes_by_cells")) == GOLDEN_ENTRIES
    sparse = read_counts(spark, str(path), "genes_by_cells", keep_zeros=False)
    assert {r["cell"] for r in sparse.axes.cells.collect()} == set(GOLDEN)
    assert {r["variable"] for r in sparse.axes.genes.collect()} == set(GENES)


def test_headers_labels_and_odd_values(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text(
        "id,A.B,A B,A.B,HLA-A,RP11(x)\n"
        '"T.cell (1)\t,x",1,,2.5,NaN,7\n'
        "plain,0,text,3,4,1e3\r\n"
        "plain,5,6,7,8,9\n"
        "\n"
    )
    with pytest.raises(PySparkException, match="not a number: text"):
        read_counts(spark, str(path)).entries.collect()
    counts = read_counts(spark, str(path), bad_as_null=True)
    rows = sorted(((r["cell"], r["variable"], r["value"]) for r in counts.entries.collect()), key=str)
    names = ["A_B1", "A_B", "A_B3", "HLA-A", "RP11_x_"]
    expected = [("T_cell__1__,x", g, v) for g, v in zip(names, [1.0, None, 2.5, None, 7.0])]
    expected += [("plain", g, v) for g, v in zip(names, [0.0, None, 3.0, 4.0, 1000.0])]
    expected += [("plain", g, v) for g, v in zip(names, [5.0, 6.0, 7.0, 8.0, 9.0])]
    assert rows == sorted(expected, key=str)
    copies = {r["cell"]: r["copies"] for r in counts.axes.cells.collect()}
    assert copies == {"T_cell__1__,x": 1, "plain": 2}
    raw = read_counts(spark, str(path), clean=False, bad_as_null=True)
    assert "T.cell (1)\t,x" in {r["cell"] for r in raw.axes.cells.collect()}


def test_rows_of_the_wrong_width_fail(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("id,a,b\nx,1\n")
    with pytest.raises(PySparkException, match="expected 2 values in the row of x"):
        read_counts(spark, str(path)).entries.collect()
    with pytest.raises(ValueError, match="orientation"):
        read_counts(spark, str(path), "sideways")


def test_wide_rows_do_not_grow_the_plan(spark, tmp_path):
    path = tmp_path / "wide.csv"
    n = 25_000
    lines = [",".join(["id", *[f"g{i}" for i in range(n)]])]
    lines += [f"c{j}," + ",".join(str((i + j) % 7) for i in range(n)) for j in range(4)]
    path.write_text("\n".join(lines))
    counts = read_counts(spark, str(path), keep_zeros=False)
    total = sum((i + j) % 7 for i in range(n) for j in range(4))
    assert counts.entries.agg({"value": "sum"}).first()[0] == total
    assert qc.qc_genes(counts.entries, counts.axes).count() == n


def test_several_files_with_a_header_each(spark, tmp_path, dense):
    path = str(tmp_path / "parts")
    wide = shape.to_wide(dense, GENES, value="value").repartition(3)
    export_csv(wide, path)
    assert entries(read_counts(spark, path)) == GOLDEN_ENTRIES


def test_packed_table_is_the_same_file(spark, tmp_path, sparse, axes):
    odd = [("c1", 'a"b', None), ("c2", "x,y", 7), (None, "G1", 4), ("c2", "x,y", 9)]
    tall = sparse.select("cell", "variable", "value").unionByName(spark.createDataFrame(odd, sparse.schema))
    for index, columns in (("cell", "variable"), ("variable", "cell")):
        kinds = [shape.to_wide(tall, None, index, columns, "value", Axes.of(tall), p) for p in (False, True)]
        files = []
        for i, wide in enumerate(kinds):
            export_csv(wide, str(tmp_path / f"{index}{i}"), single_file=True)
            files.append(sorted(x.value for x in spark.read.text(str(tmp_path / f"{index}{i}")).collect()))
        assert files[0] == files[1]


def test_packed_table_has_any_number_of_columns(spark, tmp_path):
    n = 30_000
    tall = spark.range(2 * n).selectExpr("concat('c', id % 30000) AS cell", "concat('g', id % 3) AS variable", "id % 5 AS value")
    wide = shape.to_wide(tall, index="variable", columns="cell", value="value", axes=Axes.of(tall), packed=True)
    export_csv(wide, str(tmp_path / "wide"))
    read = read_counts(spark, str(tmp_path / "wide"), "genes_by_cells").entries
    assert (read.count(), read.agg({"value": "sum"}).first()[0]) == (3 * n, 2 * n)


def test_packed_table_without_rows_has_a_header(spark, tmp_path, sparse):
    none = sparse.where("false")
    export_csv(shape.to_wide(none, value="value", axes=Axes.of(none), packed=True), str(tmp_path / "none"))
    assert [x.value for x in spark.read.text(str(tmp_path / "none")).collect()] == ["cell"]


def test_header_names_and_collisions():
    assert header_names(["", "A", "a", "B"]) == ["_c0", "A1", "a2", "B"]
    assert header_names(["", "A", "a", "B"], case_sensitive=True) == ["_c0", "A", "a", "B"]
    assert clean_names(["A.B", "A B", "A_B_2", "(A)"]) == ["A_B", "A_B_3", "A_B_2", "_A_"]


def test_metadata(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text("Barcode,sp.nme,n (x)\nT.1 a,mouse,3\n")
    df = read_metadata(spark, str(path), cell_column="Barcode")
    assert (df.columns, tuple(df.first())) == (["cell", "sp_nme", "n__x_"], ("T_1_a", "mouse", 3))


def test_saved_stages(spark, tmp_path, dense):
    path = str(tmp_path / "stage")
    write_table(dense, path, cluster_by=("cell", "variable"))
    write_table(dense, path)
    assert read_table(spark, path).exceptAll(dense).count() == 0
    saved = materialise(dense)
    assert saved.schema == dense.schema and saved.exceptAll(dense).count() == 0
    plan = saved._jdf.queryExecution().toString()
    assert "FileScan parquet" in plan or "parquet" in plan


def test_aggregation_of_a_bucketed_table_needs_no_shuffle(spark, tmp_path, dense):
    write_bucketed(dense, "bucketed_counts", 4, path=str(tmp_path / "bucketed"))
    try:
        summary = qc.qc_cells(spark.table("bucketed_counts"))
        assert "Exchange" not in summary._jdf.queryExecution().executedPlan().toString()
        assert summary.count() == 6
    finally:
        spark.sql("DROP TABLE bucketed_counts")


def test_melt_and_transpose_are_inverse(dense):
    wide = shape.to_wide(dense, value="value")
    assert shape.melt(wide).exceptAll(dense).count() == 0
    back = shape.transpose(shape.transpose(wide), "variable", "cell")
    assert table(back, "cell") == table(wide, "cell")


@pytest.mark.parametrize(
    ("kinds", "expected"),
    [
        ("i int, d double, s string", ["1", "2.5", "x"]),
        ("i int, d double, s float", [1.0, 2.5, 0.5]),
        ("i bigint, d int, s smallint", [9007199254740993, 2, 3]),
        ("i bigint, d int, s double", [7.0, 2.0, 0.5]),
    ],
)
def test_melt_loses_no_mixed_value(spark, kinds, expected):
    row = [None if v is None else v for v in expected]
    typed = [float(v) if k.split()[1] in ("double", "float") else str(v) if k.endswith("string") else int(v) for k, v in zip(kinds.split(", "), row)]
    df = spark.createDataFrame([("a", *typed), ("b", None, None, None)], f"cell string, {kinds}")
    got = {(r["cell"], r["variable"]): r["value"] for r in shape.melt(df).collect()}
    assert got == {("a", n): v for n, v in zip("ids", expected)} | {("b", n): None for n in "ids"}


def test_labels_that_differ_in_case_only(spark):
    tall = spark.createDataFrame([("a", "GAPDH", 1), ("a", "Gapdh", 2), ("b", "Gapdh", 3)], "cell string, variable string, value int")
    from tallmat.operators.axes import Axes

    wide = shape.to_wide(tall, value="value", axes=Axes.of(tall))
    assert sorted(tuple(r) for r in wide.collect()) == [("a", 1, 2), ("b", 0, 3)]


def test_headers_are_named_in_spark_as_on_the_driver(spark, tmp_path):
    for raw in (["", "A", "a", "B"], ["id", "A.B", "A B", "A_B_2", "(A)", "A(B", "A_B_4"], ["x", 'say ""hi""', "a,b", "", "B.1", "B 1", "B_1_02"]):
        line = ",".join(f'"{n}"' if "," in n or '"' in n else n for n in raw)
        path = tmp_path / f"{abs(hash(line))}.csv"
        path.write_text(f"{line}\nr," + ",".join("1" for _ in raw[1:]) + "\n")
        names = clean_names(header_names([n.replace('""', '"') for n in raw]))[1:]
        found = read_counts(spark, str(path)).entries.collect()
        assert sorted(r["variable"] for r in found) == sorted(names)


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from tallmat.stages import scratch_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, applicationId="app")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(session)
    session.conf = SimpleNamespace(get=lambda key, default: "hdfs:///work/")
    assert scratch_dir(session) == "hdfs:///work/app"


def test_densify_restores_what_sparsify_dropped(dense, sparse, axes):
    assert shape.densify(sparse, axes).exceptAll(dense).count() == 0
    assert shape.densify(sparse, axes).count() == 30


def test_clustering_computes_rows_once_and_keeps_cells_together(spark, tmp_path):
    """Ranges would be sampled first, which computes the rows a second time."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(600).selectExpr("concat('C-', id % 40) AS cell", "concat('G', id) AS variable", "id AS value")
    write_table(rows.mapInPandas(counted, rows.schema), str(tmp_path / "t"), cluster_by=("cell", "variable"))
    assert made.value == 600
    read = read_table(spark, str(tmp_path / "t"))
    assert read.agg(F.count(F.lit(1)), F.sum("value")).first()[:] == (600, 600 * 599 // 2)
    files = read.withColumn("file", F.input_file_name()).groupBy("cell").agg(F.count_distinct("file").alias("n"))
    assert files.where("n > 1").count() == 0
