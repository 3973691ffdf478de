"""Damaged files, long chains, passwords, comparison, functions, and what queries over files do not show."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions import codecs, crypt
from folioforge.operators import copying, navigation, resources, views
from folioforge.plans.navigation import conversation_file
from folioforge.plans.resources import page_file
from folioforge.plans.views import full_file
from folioforge.sources import files, syntax, writer
from folioforge.sources.syntax import Name, Ref, Stream

SAMPLES = [page_file(7, "Supplier seven"), conversation_file([(k, "user", f"text {k}") for k in range(9)]), full_file(5, "five"), writer.flat_document([writer.text_content(["a line"])], {"Title": "t"}, packed=True)]


def damaged(seed):
    r = random.Random(seed)
    data = bytearray(r.choice(SAMPLES))
    for _ in range(r.randint(1, 12)):
        at, how = r.randrange(len(data)), r.randrange(6)
        if how == 0:
            data[at] = r.randrange(256)
        elif how == 1:
            del data[at : at + r.randint(1, 40)]
        elif how == 2:
            data[at:at] = r.choice([b"[", b"<<", b">>", b"(", b"/W 5", b" 1 0 R", b"99999999999999999999", b"-1", b"null", b"]", b"stream\n", b"endobj"])
        elif how == 3:
            data[at : at + 20] = data[(b := r.randrange(len(data))) : b + 20]
        elif how == 4 and (k := data.find(b"/", at)) >= 0:
            data[k + 1 : k + 2] = b"Z"
        else:
            data = data[: max(at, 20)]
    return bytes(data)


def test_damaged_files_are_rows(spark):
    rows = [(str(i), damaged(i)) for i in range(400)] + [("none", None), ("empty", b""), ("array", b"%PDF-1.4\nxref\n0 0\ntrailer\n[1 2]\nstartxref\n9\n%%EOF")]
    made = spark.createDataFrame(rows, "file_id string, content binary").repartition(4)
    n = len(rows)
    for got in (files.nodes(made), files.streams(made), files.xref_raw(made), files.scanned(made), resources.fonts(made), resources.images(made), resources.colour_spaces(made), resources.page_contents(made), resources.page_resources(made)):
        ids = {r.file_id for r in got.select("file_id").distinct().collect()}
        assert {"none", "empty", "array"} <= ids and len(ids) <= n
    for got in (navigation.outline(made), navigation.fields(made), navigation.annotations(made), navigation.attachments(made), navigation.page_labels(made), copying.destinations(made), copying.appearances(made), copying.loads(made)):
        assert got.where("error_code IS NOT NULL").count() > 0
    for name in views.FIELDS:
        assert views.view(made, name).where("error_code = 'HeaderNotFound'").count() >= 2
    assert writer.revised(made, writer.rebuilt).where("error_code IS NOT NULL").count() > 0
    assert copying.fdf_fields(made).where("error_code = 'HeaderNotFound'").count() == n


def test_chains_of_any_length_are_copied():
    b = writer.Builder()
    items = [b.promise() for _ in range(5000)]
    for k, ref in enumerate(items):
        b.fulfil(ref, {"Title": b"%d" % k} | ({"Next": items[k + 1]} if k + 1 < len(items) else {}))
    f = files.File.open(b.save({"Root": b.create({"Type": Name("Catalog"), "Outlines": {"First": items[0]}})}))
    into = writer.Builder()
    known = writer.imported(f, [f.trailer["Root"]], into)
    g = files.File.open(into.save({"Root": known[f.trailer["Root"].id]}))
    assert len(known) == 5001 and copying.same(f, f.trailer["Root"], g, g.trailer["Root"])
    into.changes[known[items[4000].id].id] = {"Title": b"other"}
    g = files.File.open(into.save({"Root": known[f.trailer["Root"].id]}))
    assert not copying.same(f, f.trailer["Root"], g, g.trailer["Root"])


def test_comparison_is_up_to_numbers():
    def made(*values):
        b = writer.Builder()
        refs = [b.create(v) for v in values]
        root = b.create({"A": refs[0], "B": refs[-1], "N": 1})
        return files.File.open(b.save({"Root": root}))

    one, two, shared = made([1], [1]), made([1], [syntax.Real(1.0)]), made([1])
    eq = lambda f, g: copying.same(f, f.trailer["Root"], g, g.trailer["Root"])
    assert eq(one, two) and eq(one, one) and not eq(one, shared) and not eq(one, made([1], [2]))


def test_metadata_may_stay_plain():
    calls = []

    class Plain:
        encrypt_metadata, skip = False, -1

        def decrypt(self, number, gen, data):
            calls.append(number)
            return b"?" * len(data)

    b = writer.Builder()
    a, c = b.create(Stream({"Type": Name("Metadata")}, b"plain")), b.create(Stream({}, b"sealed"))
    f = files.File.open(b.save({"Root": b.create({})}))
    f.decoder = Plain()
    f.cache.clear()
    assert f.get(a.id).data == b"plain" and f.get(c.id).data == b"??????" and calls == [c.id]


def test_passwords_are_prepared():
    assert crypt.prepared("I­X".encode()) == b"IX" and crypt.prepared("ª".encode()) == b"a" and crypt.prepared("Ⅸ".encode()) == b"IX" and crypt.prepared("a b".encode()) == b"a b"
    assert crypt.prepared(b"\xff\xfe") == b"\xff\xfe" and crypt.prepared(b"") == b""
    for bad in ("\u0007", "ا" + "1"):
        with pytest.raises(crypt.CryptError):
            crypt.prepared(bad.encode())


def test_cut_streams_are_errors():
    whole = codecs.flate_encode(b"some data " * 500)
    assert codecs.flate_decode(whole) == b"some data " * 500
    with pytest.raises(codecs.CodecError):
        codecs.flate_decode(whole[:-20])


def test_programs_and_samples_against_plain_arithmetic():
    f = files.File.open(writer.flat_document([b""]))
    run = resources._stack(b"{ dup 3 -1 roll exch 1 index sub abs 2 mul 0.5 add 3 1 roll pop }")
    x, y = 0.25, 0.75
    assert run([x, y]) == [abs(y - x) * 2 + 0.5, y]
    r = random.Random(3)
    grid = [[[r.randrange(256) for _ in range(3)] for _ in range(2)] for _ in range(4)]  # z, y, x
    data = bytes(v for plane in grid for row in plane for v in row)
    g = resources.function(f, Stream({"FunctionType": 0, "Domain": [0, 1] * 3, "Range": [0, 1], "Size": [3, 2, 4]}, data))
    for _ in range(50):
        p = [r.random() * 1.2 - 0.1 for _ in range(3)]
        q = [min(max(v, 0), 1) * n for v, n in zip(p, (2, 1, 3))]
        at = lambda i, j, k: grid[k][j][i] if i < 3 and j < 2 and k < 4 else 0
        i, j, k = (int(v) for v in q)
        a, b, c = (v - int(v) for v in q)
        want = sum(at(i + di, j + dj, k + dk) * (a if di else 1 - a) * (b if dj else 1 - b) * (c if dk else 1 - c) for di in (0, 1) for dj in (0, 1) for dk in (0, 1)) / 255
        assert g(p)[0] == pytest.approx(want)
    for bad in ({"FunctionType": 7, "Domain": [0, 1]}, {"FunctionType": 2, "N": 1}, [1]):
        with pytest.raises(files.FAULTS):
            resources.function(f, bad)


def test_own_records_and_strict_readers(spark):
    views.register("Extra", "Catalog.Extra", "Size:int! Note:string")
    b = writer.Builder()
    b2 = writer.Builder()
    good = b.save({"Root": b.create({"Extra": {"Size": 3, "Note": 7}})})
    lost = b2.save({"Root": b2.create({"Extra": {"Note": b"x"}})})
    made = spark.createDataFrame([("a", good), ("b", lost)], "file_id string, content binary")
    got = {r.file_id: r for r in views.view(made, "Extra").collect()}
    assert (got["a"].Size, got["a"].Note, got["a"].error_code, got["b"].error_code) == (3, None, None, "MissingEntry")
    strict = {r.file_id: r.error_code for r in views.view(made, "Extra", files.Options(tolerant=False)).collect()}
    assert strict == {"a": "UnexpectedPrimitive", "b": "MissingEntry"}
    del views.FIELDS["Extra"], views.SOURCES["Extra"]


def test_cursor():
    lex = syntax.Lexer(b"one  two\nthree")
    lex.pos = lex.end
    assert [lex.back(), lex.back(), lex.back()] == [b"three", b"two", b"one"] and lex.boundary(1) == 3 and lex.boundary_back(7) == 5
    with pytest.raises(syntax.SyntaxIssue):
        lex.back()
    assert syntax.span(10) == (0, 10) and syntax.span(10, 3, 5) == (3, 5)
    for bad in ((5, 3), (0, 11), (-1, 2)):
        with pytest.raises(syntax.SyntaxIssue):
            syntax.span(10, *bad)
