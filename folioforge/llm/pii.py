"""Personal data: candidate generators, a boosted-tree judge and calibrated thresholds, by SQL functions alone.

Fixed formats (email, ip, card, phone) are spans of their own. Beside them, generators with high recall propose further
spans, which may overlap; a boosted model looks at the format and the words before each of them, and a threshold for
each generator decides. The trees are grown on the driver from strings that grammars below produce (seeded, bounded,
no data of the corpus), then written out as SQL, so the executors run nothing but SQL functions.
"""

from __future__ import annotations

import functools
import random
import re
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm import quality

KINDS = ("email", "ip", "card", "phone")

#: The fixed formats as Java patterns. A match can only begin where a run of its first class begins (or where the last
#: match ended), and repetitions give nothing back: the same matches, in linear time and without deep recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": ("@",), "ip": (".",), "card": (), "phone": ("+",)}

#: Generators of further candidates: (kind, Java and Python pattern), in the order in which they are listed.
GENERATORS = (
    ("secret", r"[A-Za-z0-9_+/=-]{20,}+"),
    ("local_phone", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    ("id_number", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("account", r"[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})(?![A-Za-z0-9])"),
    ("spelled_email", r"[A-Za-z0-9._-]++(?: at |\(at\)|\[at\]| \[at\] | \(at\) )[A-Za-z0-9-]++(?: dot |\(dot\)|\[dot\]| \[dot\] | \(dot\) )[A-Za-z]{2,}+"),
)
#: Characters of an account number by country, and how many letters follow its check digits.
IBAN = {"DE": (22, 0), "FR": (27, 0), "ES": (24, 0), "GB": (22, 4), "IT": (27, 1), "NL": (18, 4), "BE": (16, 0), "AT": (20, 0), "CH": (21, 0), "NO": (15, 0), "PL": (28, 0), "PT": (25, 0), "MT": (31, 4)}
BEFORE = 24
#: Characters of a candidate in which runs of digits and distinct characters are counted; spans have no such bound.
LOOK = 4096

#: Words before a candidate that speak for or against it, in English, German, French, Spanish and Italian.
CUES = (
    r"(?iu)(token|key|secret|passw(or)?d|auth|bearer|credential|passwort|kennwort|schlüssel|jeton|mot de passe|clé|clave|contraseña|parola|chiave)[^A-Za-z0-9]*$",
    r"(?iu)(tel|phone|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono|handy|mobil|rufen|llamar|appeler|chiama)[^A-Za-z0-9]*$",
    r"(?iu)(ssn|social|social security number|iban|account|passport|konto|cuenta|compte|conto|id|ausweis|steuernummer|versicherung|dni|nif|identidad|identité|identità|no|nr|number|nummer|número|numéro|numero)[^A-Za-z0-9]*$",
    r"(?iu)(mail|contact|write|address|kontakt|schreib(en|e)?|correo|escrib(e|ir)|courriel|écri(re|vez)|scriv(i|ere)|contatto|reach)[^A-Za-z0-9]*$",
    r"[A-Za-z0-9_]$",
    r"[\"'=:]\s*$",
    r"(?iu)(isbn|doi|order|invoice|version|page|sku|ref|commit|sha|sha1|sha256|md5|hash|bestellung|rechnung|pedido|factura|commande|facture|ordine|fattura)[^A-Za-z0-9]*$",
)
#: Marks of a candidate's own format: what keys begin with, endings of mail hosts, groups of a number that is issued.
FORMS = (
    r"^(sk|pk|rk|ghp|gho|xox[abp]|glpat|AKIA|AIza|eyJ)",
    r"(?iu)[^A-Za-z](com|org|net|edu|gov|info|io|co|eu|de|fr|es|it|uk|nl|ch|at)$",
    r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])",
)
FEATURES = ("generator", "length", "digits", "upper", "hexes", "marks", "turns", "distinct", *[f"cue{i}" for i in range(len(CUES))], *[f"form{i}" for i in range(len(FORMS))], "checked", "followed")


def spans_of(text: Column, pattern: str, context: int = 0) -> Column:
    """array<struct<m, s, e[, b, a]>>: the leftmost non-overlapping matches with places in code points.

    Matches are fenced by two control characters, which the text itself has lost to a third of the same length, and the
    places are the running lengths of the pieces. context adds the characters before (b) and the one after (a).
    """
    clean = F.translate(text, "\u0001\u0002", "\u0003\u0003")
    parts = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit("\u0001$0\u0002")), "\u0001")
    pieces = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\u0002", 1).alias("m"), F.length(p).alias("n")))

    def step(acc: Column, p: Column) -> Column:
        start, end = acc["pos"], acc["pos"] + F.length(p["m"])
        return F.struct((start + p["n"] - 1).alias("pos"), F.concat(acc["out"], F.array(F.struct(p["m"].alias("m"), start.alias("s"), end.alias("e")))).alias("out"))

    none = F.from_json(F.lit("[]"), "array<struct<m string, s int, e int>>")
    head = F.struct(F.length(F.element_at(parts, 1)).alias("pos"), none.alias("out"))
    found = F.aggregate(F.slice(pieces, 2, F.size(parts)), head, step, lambda acc: acc["out"])
    if context:
        found = F.transform(found, lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"), x["e"].alias("e"), F.substring(clean, F.greatest(x["s"] - context, F.lit(0)) + 1, F.least(x["s"], F.lit(context))).alias("b"), F.substring(clean, x["e"] + 1, F.lit(1)).alias("a")))
    return found


def luhn(digits: Column) -> Column:
    """Whether the check sum over the digits, every second one from the right doubled, ends in 0."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)),
        F.lit(0),
        lambda a, v: a + F.when(v > 9, v - 9).otherwise(F.coalesce(v, F.lit(0))),
    ) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


# The judge of further candidates -------------------------------------------------------------------------------------


ACCOUNT = 3


def checked(m: str) -> bool:
    """Whether an account number's two check digits are right: its characters as numbers, the first four last, leave 1 modulo 97."""
    m = m.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97 == 1


def checked_sql(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, LOOK), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def candidate_features(g: int, m: str, b: str, a: str) -> list[float]:
    """FEATURES of one candidate; candidate_sql has the same in SQL."""
    count = lambda chars: len(m) - len(m.translate(str.maketrans("", "", chars)))
    return [
        g, len(m), count(string.digits), count(string.ascii_uppercase), count("0123456789abcdefABCDEF"), len(m) - count(string.digits + string.ascii_letters),
        len(re.findall("[0-9]+", m[:LOOK])), len(set(m[:LOOK])), *[float(bool(re.search(c, b))) for c in CUES], *[float(bool(re.search(c, m[:LOOK]))) for c in FORMS],
        float(g == ACCOUNT and checked(m)), float(bool(re.match("[A-Za-z0-9_]", a))),
    ]


def candidate_sql(g: int, x: Column) -> list[Column]:
    m, b = x["m"], x["b"]
    kept = lambda chars: F.length(F.regexp_replace(m, f"[^{chars}]", ""))
    return [
        F.lit(g), F.length(m), kept("0-9"), kept("A-Z"), kept("0-9a-fA-F"), F.length(m) - kept("0-9A-Za-z"),
        F.size(F.regexp_extract_all(F.substring(m, 1, LOOK), F.lit("[0-9]+"), F.lit(0))), F.size(F.array_distinct(F.regexp_extract_all(F.substring(m, 1, LOOK), F.lit("."), F.lit(0)))), *[b.rlike(c).cast("int") for c in CUES], *[F.substring(m, 1, LOOK).rlike(c).cast("int") for c in FORMS],
        checked_sql(m).cast("int") if g == ACCOUNT else F.lit(0), x["a"].rlike("^[A-Za-z0-9_]").cast("int"),
    ]


def grammar(r: random.Random) -> tuple[int, str, str, str, int]:
    """One labelled candidate: (generator, match, before, after, is personal).

    Some are personal by the words before them, in five languages, some by their own format alone: a right check number,
    what a key begins with, a known ending of a host. The others look alike but lack both, or stand after a word that
    speaks against them.
    """
    pick = r.choice
    words = lambda n: " ".join("".join(r.choices("aeiounrtsl", k=r.randint(2, 8))) for _ in range(n))
    d = lambda n: "".join(r.choices(string.digits, k=n))
    filler = (words(4) + pick([" ", " ", ", ", ". ", "\n", " | ", " (", ": "]))[-BEFORE:]
    cue = lambda text: (words(3) + " " + pick(text.split("|")) + pick([" ", ": ", " = \"", "=", ": '", " is ", " est ", " "]))[-BEFORE:]
    against = lambda: cue("isbn|order|ref|version|invoice|commit|sha1|md5|Bestellung|Rechnung|pedido|factura|commande|facture|SKU")
    secret = "token|api_key|secret|password|auth|Passwort|Schlüssel|jeton|mot de passe|clave|contraseña|chiave|TOKEN|Key"

    def account(right: bool) -> str:
        land = pick(list(IBAN))
        rest = "".join(r.choices(string.ascii_uppercase, k=IBAN[land][1])) + d(IBAN[land][0] - 4 - IBAN[land][1])
        sum_ = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
        return land + f"{sum_ if right else (sum_ + r.randint(1, 90)) % 97:02d}" + rest

    g, good = r.randrange(len(GENERATORS)), r.random() < 0.5
    after = pick([" ", "\"", ".", ",", "\n", "", ")", ";"])
    if g == 0:
        alphabet = pick(["0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters, string.ascii_letters + string.digits + "+/"])
        body = "".join(r.choices(alphabet, k=pick([20, 24, 32, 40, 48, 64, 128, 256, 441, 900])))
        if good and r.random() < 0.25:
            body = "".join(r.choices(string.ascii_letters + string.digits, k=r.randint(24, 60)))
            return g, pick(["sk-", "ghp_", "xoxb-", "glpat-", "AKIA", "AIza", "eyJ"]) + body, pick([filler, cue(secret)]), after, 1
        if good:
            return g, body, cue(secret), after, 1
        if r.random() < 0.15 and len(m := account(True)) >= 20:
            return g, m, cue("iban|account|konto|IBAN"), after, 0  # an account, not a secret
        m = pick(["".join(r.choices("etaoinshrdlu", k=r.randint(20, 60))), pick("-=_") * r.randint(20, 900), "-".join("".join(r.choices("etaoinshrdlu", k=r.randint(3, 9))) for _ in range(pick([5, 5, 30, 90]))), d(r.randint(20, 30)), "/".join(words(1) for _ in range(pick([6, 6, 30, 90]))), "".join(r.choices("ETAOINSHRDLU", k=r.randint(20, 40))), "".join(r.choices("0123456789abcdef", k=pick([32, 40, 64])))])
        return g, m.ljust(20, "e"), pick([filler, filler, against()]), after, 0
    if g == 1:
        m = pick(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(d(3), d(3), d(4))
        if good:
            return g, m, cue("tel|phone|call|mobile|fax|Phone|Tel.|Telefon|Handy|téléphone|teléfono|telefono|cell"), after, 1
        return g, m, pick([filler, against(), words(3)[-12:] + d(3), "+1 "]), pick([after, d(1)]), 0
    if g == 2:
        issued = f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
        if good:
            return g, issued, cue("ssn|social|SSN|id|social security number|Ausweis|Steuernummer|Versicherung|DNI|identité|número|Nr.|no."), after, 1
        return g, pick([issued, f"{pick(['000', '666'])}-{d(2)}-{d(4)}", f"{r.randint(900, 999)}-{d(2)}-{d(4)}"]), pick([filler, against(), d(2)]), pick([after, d(1)]), 0
    if g == 3:
        named = good and r.random() < 0.6
        right = r.random() < 0.5 if named else good or r.random() < 0.1
        m = account(right)
        if not good and not right and r.random() < 0.4:
            m = m[:2] + d(2) + "".join("".join(r.choices(string.ascii_uppercase, k=4)) for _ in range(pick([3, 5])))
        if r.random() < 0.5:
            m = " ".join(m[i : i + 4] for i in range(0, len(m), 4))
        if good:
            return g, m, cue("iban|account|konto|IBAN|cuenta|compte|conto") if named else filler, after, 1
        return (g, m, against(), d(1), 0) if right else (g, m, pick([filler, against()]), pick([after, "A"]), 0)
    name, host = "".join(r.choices("abcdefghilmnorst", k=r.randint(3, 9))), "".join(r.choices("aeilmnopqrst", k=r.randint(3, 9)))
    ending = pick("com org net de fr es it io edu uk".split())
    if good:
        mark = pick([("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), (" (at) ", " (dot) ")])
        return g, f"{name}{pick(['.', '_', ''])}{pick([d(2), 'smith', ''])}{mark[0]}{host}{mark[1]}{ending}", pick([filler, cue("mail|contact|write|address|Kontakt|schreiben|correo|courriel|contatto")]), after, 1
    return g, f"{name} at {host} dot {''.join(r.choices('aeinrst', k=r.randint(3, 9)))}", filler, after, 0


@functools.cache
def judge(seed: int = 8, rows: int = 9000) -> tuple[quality.Trees, dict[int, float]]:
    """The boosted trees, and for each generator the least calibrated threshold.

    On the half that the trees have not seen, a threshold is the lowest probability from which on at least 99 % of the
    generated candidates are personal; at least 0.5.
    """
    r = random.Random(seed)
    drawn = [grammar(r) for _ in range(rows)]
    x = np.array([candidate_features(*c[:4]) for c in drawn], np.float32)
    y = np.array([c[4] for c in drawn], float)
    half = rows // 2
    model = quality.fit(x[:half], y[:half], trees=28, depth=4, rate=0.3, bins=32)
    p, cuts = model.probability(x[half:]), {}
    for g in range(len(GENERATORS)):
        own = x[half:, 0] == g
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[half:][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= 0.99)
        cuts[g] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
    return model, cuts


def tree_sql(model: quality.Trees, name: str = "f") -> str:
    """The model's margin as SQL over the fields `name`[i]."""

    def node(at: int) -> str:
        if model.left[at] == at:
            return f"{model.value[at]!r}D" if not isinstance(model.value[at], np.floating) else f"{float(model.value[at])!r}D"
        return f"CASE WHEN {name}[{int(model.feature[at])}] <= {float(model.cut[at])!r}D THEN {node(model.left[at])} ELSE {node(model.right[at])} END"

    return " + ".join([f"{model.base!r}D", *[f"({node(r)})" for r in model.roots]])


# Whole texts ---------------------------------------------------------------------------------------------------------


def base_spans(text: Column, kind: str) -> Column:
    hits = F.filter(spans_of(text, BASE[kind]), lambda x: valid(kind, x["m"]))
    return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def candidates(text: Column, g: int, pattern: str) -> Column:
    return F.transform(spans_of(text, pattern, BEFORE), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array(*[c.cast("double") for c in candidate_sql(g, x)]).alias("f")))


def clear_of(spans: Column, taken: Column) -> Column:
    return F.filter(spans, lambda x: ~F.exists(taken, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, `base` and `more`: arrays of struct<kind, s, e> for every row, and the columns `keep`.

    base has the fixed formats by kind and place, more the accepted further candidates by generator and place; a further
    span that overlaps a fixed one, or one of an earlier generator, is left out. A null text has no spans; repeated rows
    and keys stay. No shuffle: every row is judged where it is read.
    """
    empty = F.from_json(F.lit("[]"), "array<struct<kind string, s int, e int>>")
    t = F.coalesce(F.col(text), F.lit(""))
    own = [f"_keep{i}" for i in range(len(keep))]  # no column of `docs` can clash with those made here
    rows = docs.select(F.col(key).alias("_key"), *[F.col(c).alias(o) for c, o in zip(keep, own)], t.alias("_t"), t.rlike("[0-9]").alias("_digits"))
    base = {}
    for kind in KINDS:
        need = functools.reduce(lambda a, b: a & b, [F.contains("_t", F.lit(c)) for c in NEEDS[kind]], F.lit(True) if kind == "email" else F.col("_digits"))
        base[f"_{kind}"] = F.when(need, base_spans(F.col("_t"), kind)).otherwise(empty)
    rows = rows.withColumns(base).withColumn("base", F.concat(*base))
    model, cuts = judge()
    margin, taken = tree_sql(model), F.col("base")
    more = []
    for g, (kind, pattern) in enumerate(GENERATORS):
        need = F.col("_t").rlike(r"[\[( ]dot[\]) ]") if kind == "spelled_email" else F.lit(True) if kind == "secret" else F.col("_digits")
        fence = {"secret": "A-Za-z0-9_+/=-", "spelled_email": "A-Za-z0-9._-"}.get(kind)
        fenced = rf"(?:(?<![{fence}])|\G){pattern}" if fence else pattern
        raw = F.when(need, candidates(F.col("_t"), g, fenced))
        rows = rows.withColumn(f"_g{g}", raw)
        level = float(np.log(cuts[g] / (1 - cuts[g]))) if cuts[g] < 1 else 1e9
        rows = rows.withColumn(f"_g{g}", F.expr(f"coalesce(transform(filter(transform(_g{g}, x -> named_struct('s', x.s, 'e', x.e, 'p', transform(array(x.f), f -> {margin})[0])), x -> x.p >= {level!r}D), x -> named_struct('kind', '{kind}', 's', x.s, 'e', x.e)), from_json('[]', 'array<struct<kind string, s int, e int>>'))"))
        rows = rows.withColumn(f"_g{g}", clear_of(F.col(f"_g{g}"), taken))
        more.append(f"_g{g}")
        taken = F.concat("base", *more)
    return rows.withColumn("more", F.concat(*more)).select(F.col("_key").alias(key), *[F.col(o).alias(c) for c, o in zip(keep, own)], "base", "more")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by [KIND] of its first one."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["pos"]
        piece = F.concat(F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
