from folioforge.sources import datasource, files, writer


def test_reader_options(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(writer.flat_document([writer.text_content(["x"])], {"Title": "T"}, packed=True))
    (tmp_path / "b.pdf").write_bytes(b"startxref%PDF-")
    datasource.register(spark)
    read = lambda view: spark.read.format("docobj").option("view", view).load(str(tmp_path))
    nodes = read("nodes").collect()
    assert {r.error_code for r in nodes} == {None, "EOF"} and sum(r.kind == "Stream" for r in nodes) == 3
    assert {r.kind for r in read("xref").collect() if r.error_code is None} == {"Raw", "Stream"}
    assert [r.kind for r in read("scan").collect() if r.error_code is None].count("Dictionary") >= 2


def test_binary_files_and_tables(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(writer.flat_document([writer.text_content(["x", "y"])]))
    made = files.from_files(spark, str(tmp_path))
    assert files.nodes(made).where("error_code IS NULL").count() == files.nodes(made).count() > 10
    assert [r.type for r in files.streams(made).orderBy("obj").collect()] == [None, "XRef"]
