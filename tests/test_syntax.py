import sys

import pytest

from folioforge.sources.files import File, node_rows
from folioforge.sources.syntax import Name, Parser, Real, Ref, SyntaxIssue, hex_string, kind_of, literal_string, serialize, unescape_name
from folioforge.sources.writer import Builder, flat_document, imported, lossy_text, rebuilt, strict_text, text_content


@pytest.mark.parametrize(
    ("typed", "value"),
    [
        (rb"a\nb\rc\td\(f/)", b"a\nb\rc\td(f/"), (b"These \\\ntwo strings \\\nare the same.)", b"These two strings are the same."),
        (b"These \\\r\ntwo strings \\\r\nare the same.)", b"These two strings are the same."), (rb"\245\307)", b"\xa5\xc7"), (rb"\0053)", b"\x053"), (rb"\053)", b"+"), (rb"\53)", b"+"), (rb"\541)", b"a"), (rb"\q)", b"\x00q"), (b"a(b)c)", b"a(b)c"),
    ],
)
def test_literal_strings(typed, value):
    assert literal_string(typed, 0)[0] == value


@pytest.mark.parametrize(("typed", "value"), [(b"901FA3>", "901FA3"), (b"901FA>", "901FA0"), (b"1 9F\t5\r\n4\x0c62a>", "19F5462A")])
def test_hex_strings(typed, value):
    assert hex_string(typed, 0)[0] == bytes.fromhex(value)


def test_values():
    assert Parser(b"<</App<</Name/>>>>").value() == {"App": {"Name": Name("")}}
    assert Parser(b"<</ true>>").value() == {"": True}
    assert Parser(b"[]").value() == []
    p = Parser(b"[(Complete L)20(egend for Physical and P)20(olitical Maps)]TJ")
    assert len(p.value()) == 5 and p.next() == b"TJ" and p.peek() == b""
    assert [kind_of(Parser(x).value()) for x in (b"123", b"123.", b"123.45", b".45", b"-.45", b"4 0 R", b"4-5")] == ["Integer", "Number", "Number", "Number", "Number", "Reference", "Number"]
    assert Parser(b"4-5").value() == 4.0 and Real(0.1) != 0.1
    with pytest.raises(SyntaxIssue, match="MaxDepth"):
        Parser(b"[" * 30 + b"]" * 30).value()
    with pytest.raises(SyntaxIssue):
        Parser(b"99999999999").value()
    assert unescape_name(b"A#20B") == "A B"
    with pytest.raises(SyntaxIssue, match="HexDecode"):
        unescape_name(b"A#2")


def test_serialize_parse_again():
    v = {"A": [1, Real(0.5), True, None, b"a(b\\", b"\x00\xff", Name("N"), Ref(3, 1)], "E": {}, "Z": None}
    assert Parser(serialize(v)).value() == {"A": v["A"]}


@pytest.mark.parametrize("data", [b"startxref%PDF-", b"%PDF-startxref>", b"%PDF-startxref<", b"", b"%PDF-1.7 junk"])
def test_malformed_files_are_errors(data):
    with pytest.raises(SyntaxIssue):
        File.open(data)


def test_texts():
    assert [lossy_text(bytes.fromhex(x)) for x in ("FEFF2009", "FEFFD834", "FEFFD83420", "FEFF00E4")] == [" ", "�", "�", "ä"]
    assert lossy_text(b"mit\xe4") == "mit�" and strict_text(b"mit\xc3\xa4") == "mitä"
    for bad in (b"mit\xe4", b"\xfe\xff\xd8\x34"):
        with pytest.raises(SyntaxIssue):
            strict_text(bad)


OLD = b"""%PDF-1.4
1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj
2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 612 792]/Rotate 90>> endobj
3 0 obj <</Type/Page/Parent 2 0 R/Contents 4 0 R>> endobj
4 0 obj <</Length 5 0 R>> stream
BT (Hi) Tj ET
endstream endobj
5 0 obj 13 endobj
"""


def classic():
    places = [OLD.index(b"%d 0 obj" % i) for i in range(1, 6)]
    table = b"xref\n0 6\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places)
    return OLD + table + b"trailer <</Size 6/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % len(OLD)


def test_classic_table_rebuild_and_scan():
    f = File.open(classic())
    assert f.version == "PDF-1.4" and f.get(4).data == b"BT (Hi) Tj ET" and f.get(3).get("Rotate") is None
    g = File.open(rebuilt(f))
    assert g.get(4).data == f.get(4).data and g.get(4).info["Length"] == 13 and g.get(2) == f.get(2)
    assert [r.id for r, _, e in f.scan() if e is None and r] == [1, 2, 3, 4, 5]


def test_updates_promises_and_import():
    f = File.open(flat_document([text_content(["a"]), text_content(["b"])], {"Title": "Tü"}, packed=True))
    b = Builder(f)
    b.update(f.trailer["Info"], {"Author": b"me"}, merge=True)
    kid = f.resolve(f.resolve(f.resolve(f.trailer["Root"])["Pages"]))["Kids"][0]
    moved = b.update(kid, {"Type": Name("Page")})
    assert moved.id != kid.id  # members of an object stream get a new number
    g = File.open(b.save({"Root": f.trailer["Root"], "Info": f.trailer["Info"]}))
    assert g.resolve(g.trailer["Info"]) == {"Title": f.resolve(f.trailer["Info"])["Title"], "Author": b"me"} and len(g.sections) == 2
    lost = Builder()
    lost.promise()
    with pytest.raises(SyntaxIssue, match="Promise"):
        lost.save({})
    into = Builder()
    known = imported(f, [f.resolve(f.trailer["Root"])["Pages"]], into)
    assert len(known) == 5 and not into.open
    assert [r[8] for r in node_rows("f", 1, 0, {"A": [1, Ref(2)]})] == ["Dictionary", "Array", "Integer", "Reference"]


def test_index_in_runs():
    from folioforge.sources.files import File
    from folioforge.sources.writer import Builder, runs

    assert runs([1, 2, 3, 7, 9, 10]) == [1, 3, 7, 1, 9, 2] and runs([]) == []
    b = Builder()
    refs = [b.create(i) for i in range(500)]
    f = File.open(b.save({"Root": refs[0]}))
    assert f.trailer["Index"] == [1, 501] and [f.get(r.id) for r in refs] == list(range(500))


def test_reading_takes_one_step_a_token(monkeypatch):
    from folioforge.sources import files, syntax

    made, skips = [], []
    entry, skip = files.Entry, syntax.Lexer.skip
    monkeypatch.setattr(files, "Entry", lambda *a: made.append(a) or entry(*a))
    monkeypatch.setattr(syntax.Lexer, "skip", lambda self: skips.append(1) or skip(self))
    b = Builder()
    root = b.create({"A": [[1, Real(0.5), b"x"], {"B": Name("C"), "D": Ref(3, 1)}] * 50})
    f = File.open(b.save({"Root": root}))
    assert f.root["A"][1] == {"B": "C", "D": Ref(3, 1)} and len(f.root["A"]) == 100
    assert len(made) == len(f.table) == 2 and not skips  # a row of the index is one entry; white space goes with its token


def calls(f):
    """Calls of Python functions that f() makes, once what is kept is known."""
    f()
    made = []
    sys.setprofile(lambda frame, event, arg: event == "call" and made.append(frame.f_code.co_name))
    try:
        f()
    finally:
        sys.setprofile(None)
    return len(made)


def test_writing_takes_a_call_a_value_at_most():
    value = {f"K{i}": [i, Name(f"N{i % 5}"), b"plain", Ref(i)] for i in range(50)} | {"None": None, "Empty": {}, "Zero": 0, "No": False, "List": [], "Text": b""}
    assert serialize({"A": {}, "B": None, "C": 0, "D": [], "E": b"", "F": False}) == b"<</C 0 /D [] /E () /F false>>"
    assert [serialize(v) for v in (b"a(b", b"a\\", b"a)\x7f", b"\n", b"\x7f", b"a\n")] == [b"(a\\(b)", b"(a\\\\)", b"(a\\)\x7f)", b"<0a>", b"(\x7f)", b"<610a>"]
    assert calls(lambda: serialize(value)) < 250


def test_making_a_file_takes_no_call_a_key():
    from folioforge.plans.views import full_file

    assert max(calls(lambda k=k: full_file(k, "five")) for k in range(1, 13)) < 1150
    assert File.open(full_file(5, "grün")).trailer["ID"] == [b"\xfe\xff" + "grün".encode("utf-16-be"), b"x"]


def test_index_rows_are_read_by_column():
    from folioforge.sources.files import Options
    from folioforge.sources.syntax import Stream

    b, made = Builder(), []
    refs = [b.create(i) for i in range(500)]
    f = File.open(b.save({"Root": refs[0]}))
    stream = f.get(501)
    sys.setprofile(lambda frame, event, arg: event == "c_call" and arg.__name__ == "from_bytes" and made.append(1))
    try:
        f.packed_section(stream)
    finally:
        sys.setprofile(None)
    assert len(made) == 501  # only the places are wider than a byte
    cut = Stream({"W": [1, 1, 0], "Size": 3}, b"\x01\x07\x00\x02\x01")
    assert [(i, e.kind, e.pos, e.gen) for i, e in f.packed_section(cut)] == [(0, "Raw", 7, 0), (1, "Free", 2, 0)]
    f.options = Options(tolerant=False)
    with pytest.raises(SyntaxIssue, match="EOF"):
        f.packed_section(cut)
    with pytest.raises(SyntaxIssue, match="XRefStreamType"):
        f.packed_section(Stream({"W": [1, 1, 0], "Size": 3}, b"\x01\x07\x03\x02\x01"))


def test_plain_pairs_and_items_take_one_step(monkeypatch):
    from folioforge.sources import syntax

    long, steps, following = b"k" * 64, [], syntax.Lexer.next
    tricky = {
        b"[5-6]": [Real(5)], b"[5 6.5]": [5, Real(6.5)], b"[5 6 R 7]": [Ref(5, 6), 7], b"[5 6%c\nR]": [Ref(5, 6)], b"[5%c\n6 R]": [Ref(5, 6)], b"[1 2 3 R]": [1, Ref(2, 3)], b"[/" + long + b"5 6]": [long.decode() + "5", 6],
        b"<</" + long + b"5 6/B 1>>": {long.decode() + "5": 6, "B": 1}, b"<</A 5%c\n0 R>>": {"A": Ref(5)}, b"<</A/B#41/C(a\\n)/D(e)>>": {"A": "BA", "C": b"a\n", "D": b"e"}, b"<</A 1/A 2>>": {"A": 2},
    }
    for typed, value in tricky.items():
        assert Parser(typed).value() == value
    assert Parser(b"<</A(ab)/B[(cd) 1]>>", decrypt=lambda s: s[::-1]).value() == {"A": b"ba", "B": [b"dc", 1]}
    for typed in (b"[1234567890123 5]", b"<</A 2147483648/B 1>>"):
        with pytest.raises(SyntaxIssue, match="32-bit"):
            Parser(typed).value()
    monkeypatch.setattr(syntax.Lexer, "next", lambda self, issue="": steps.append(1) or following(self, issue))
    want = {f"K{i}": (i, Name("N"), b"text", Ref(i), [i, i, Ref(i, 1), b"x"])[i % 5] for i in range(100)}
    assert Parser(serialize(want)).value() == want and len(steps) < 100


def test_object_heads_take_one_step(monkeypatch):
    from folioforge.sources import syntax

    steps, following = [], syntax.Lexer.next
    monkeypatch.setattr(syntax.Lexer, "next", lambda self, issue="": steps.append(1) or following(self, issue))
    assert Parser(b" 7 0 obj\n<</A 1>>\nendobj\n").indirect() == (Ref(7), {"A": 1}) and len(steps) == 2
    assert Parser(b"7 %c\n0 obj[5]%c\nendobj").indirect(False) == (Ref(7), [5]) and Parser(b"7 0 obj<<>>endobjx").indirect() == (Ref(7), {})
    for typed in (b"7 0 objx 5 endobj", b"7 0 obj 5 endobjx", b"7 x obj 5 endobj"):
        with pytest.raises(SyntaxIssue):
            Parser(typed).indirect(False)


def steps_of(record, k):
    """Python calls that make a file, open it and read the records."""
    from folioforge.operators import views
    from folioforge.plans.views import full_file

    def run():
        f = File.open(full_file(k, "five"))
        for _, _, d, _ in views.found(f, record):
            try:
                views.row_of(f, record, d, views.fields(record))
            except SyntaxIssue:
                pass

    return calls(run)


def test_actions_are_read_in_few_steps():
    assert serialize([0, -5, 2**31, True]) == b"[0 -5 2147483648 true]"
    assert max(steps_of("Action", k) for k in range(1, 13)) < 1450


def test_viewer_preferences_are_read_in_few_steps():
    assert max(steps_of("ViewerPreferences", k) for k in range(1, 13)) < 1300
