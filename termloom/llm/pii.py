"""Personal data and secrets: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

# The base patterns, in possessive form and anchored to the start of a run or the end of
# the last match. They find what the plain patterns find, but without their backtracking over long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
# Patterns of the method's own kinds.
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
TOKEN = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}+(?![0-9A-Za-z])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])"
KEY_STARTS = r"AKIA|ASIA|AIza|gh[oprsu]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|eyJ"
KEY = (
    r"(?<![A-Za-z0-9_-])(?:A[KS]IA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[oprsu]_[0-9A-Za-z]{36,255}+|github_pat_[0-9A-Za-z_]{22,255}+|glpat-[0-9A-Za-z_-]{20,64}+"
    r"|sk-[0-9A-Za-z_-]{20,200}+|[sr]k_live_[0-9A-Za-z]{16,99}+|xox[abprs]-[0-9A-Za-z-]{10,250}+|eyJ[0-9A-Za-z_-]{10,4000}+\.[0-9A-Za-z_-]{10,4000}+\.[0-9A-Za-z_-]{10,1000}+)(?![A-Za-z0-9])"
)
PRIVATE_KEY = r"-----BEGIN (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----"
SECRET = r"""(?i)(?<![A-Za-z])(?:password|passwd|passphrase|pwd|secret)["']?\s{0,3}[=:]\s{0,3}["']?[^\s"',;]{6,128}+"""
BASE64 = r"(?<![0-9A-Za-z+/=_-])[0-9A-Za-z+/_-]{32,256}+={0,2}(?![0-9A-Za-z+/=_-])"
#: Words that make a kind likelier or less likely within CONTEXT characters before or after the span.
CONTEXT = 40
LIKELIER = {
    "email": r"(?i)\b(mail|e-mail|email|contact|write|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(ip|address|host|server|client|adresse|dirección)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(call|phone|tel|telephone|mobile|fax|contact|telefon|teléfono)\b",
    "iban": r"(?i)\b(iban|account|konto|cuenta|compte|bank)\b",
    "token": r"(?i)\b(token|key|secret|password|passwd|api|bearer)\b",
    "tel": r"(?i)\b(call|phone|tel|telephone|mobile|fax|contact|telefon|teléfono)\b",
    "base64": r"(?i)\b(token|key|secret|password|passwd|api|bearer|authorization|credential|credentials)\b",
}
UNLIKELIER = {
    "email": r"(?i)\b(example|noreply|no-reply|sample)\b",
    "ip": r"(?i)\b(version|release|section|chapter|firmware)\b",
    "card": r"(?i)\b(order|isbn|serial|tracking|example|sample|test)\b",
    "phone": r"(?i)\b(isbn|issn|order|invoice|part|serial|version)\b",
    "iban": r"(?i)\b(example|sample|test)\b",
    "token": r"(?i)\b(commit|sha|sha1|sha256|md5|checksum|digest|hash)\b",
    "tel": r"(?i)\b(isbn|issn|order|invoice|part|serial|version)\b",
    "key": r"(?i)\b(example|sample|dummy|placeholder)\b",
    "secret": r"(?i)\b(example|sample|dummy|placeholder)\b",
    "base64": r"(?i)\b(commit|sha|sha1|sha256|md5|checksum|digest|hash|integrity|image)\b",
}
#: Score of a kind before context; spans of the method's own kinds count from THRESHOLD on.
BEFORE = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.8, "token": 0.4, "tel": 0.4, "key": 0.9, "private_key": 1.0, "secret": 0.9, "base64": 0.4}
STEP, THRESHOLD = 0.3, 0.6
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "token", "tel", "key", "private_key", "secret", "base64")
CHUNK = 256


def running(lengths: Column) -> Column:
    """Exclusive prefix sums of an array, in chunks: appending one by one costs the square of the length."""

    def sums(xs):
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            xs, start,
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def chunked(xs):
        cuts = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(CHUNK)), lambda i: F.slice(xs, i + 1, CHUNK))
        return let(
            cuts,
            lambda cs: F.flatten(
                F.zip_with(
                    cs, sums(F.transform(cs, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b))),
                    lambda c, off: F.transform(sums(c), lambda p: p + off),
                )
            ),
        )

    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(let(lengths, chunked))


def find(text: Column, pattern: str, group: str = "0") -> Column:
    """Array of (start, end, hit) of a pattern's matches, in code points, end exclusive. What lies between
    the matches (split) and the matches themselves take turns, so their lengths give the places."""
    pair = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")
    )

    def placed(p):
        lengths = F.transform(
            p["hits"], lambda h, i: (F.char_length(F.get(p["gaps"], i)) + F.char_length(h)).cast("long")
        )

        def one(at, h, i):
            start = F.get(at, i) + F.char_length(F.get(p["gaps"], i))
            return F.struct(start.alias("start"), (start + F.char_length(h)).alias("end"), h.alias("hit"))

        return let(running(lengths), lambda at: F.transform(p["hits"], lambda h, i: one(at, h, i)))

    return let(pair, placed)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check: from the right every second digit doubles, less 9 above 9; the sum divides by 10."""
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: let(c.cast("int") * (F.lit(1) + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(hit: Column) -> Column:
    """ISO 7064 over an account number: first four characters to the end, letters count from 10."""
    flat = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(flat, 5, 100), F.substring(flat, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("string")).otherwise((F.ascii(c) - 55).cast("string"))
    spelt = F.array_join(F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), value), "")
    step = lambda acc, c: (acc * 10 + c.cast("int")) % 97
    return F.aggregate(F.filter(F.split(spelt, ""), lambda c: c != ""), F.lit(0), step) == 1


def _in_context(kind: str, text: Column, span: Column) -> Column:
    """Score of a span, 0 to 1, from its kind and the words around it, the span itself left out."""
    cut = lambda a, n: F.substring(text, (a + 1).cast("int"), n.cast("int"))
    start = F.greatest(span["start"] - CONTEXT, F.lit(0))
    near = F.concat_ws("\n", cut(start, span["start"] - start), cut(span["end"], F.lit(CONTEXT)))
    seen = lambda words: near.rlike(words[kind]).cast("int") if kind in words else F.lit(0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(BEFORE[kind]) + STEP * seen(LIKELIER) - STEP * seen(UNLIKELIER)))


def _spans(text: Column) -> dict:
    n_digits = lambda s: F.char_length(digits_of(s["hit"]))
    part_ok = lambda s: F.forall(F.split(s["hit"], r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(999)) <= 255)
    any_hit = lambda s: F.lit(True)
    mixed = lambda s: s["hit"].rlike("[0-9]") & s["hit"].rlike("[a-z]") & s["hit"].rlike("[A-Z]") & ~s["hit"].rlike(f"^(?:{KEY_STARTS})")
    digit = text.rlike("[0-9]")
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,score:double>>")

    def at(kind, when, pattern, keep):
        found = F.filter(find(text, pattern), keep)
        told = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), _in_context(kind, text, s).alias("score")))
        if kind not in BASE_KINDS:
            told = F.filter(told, lambda s: s["score"] >= THRESHOLD - 1e-9)
        return F.when(when, told).otherwise(none)

    return {
        "email": at("email", F.contains(text, F.lit("@")), EMAIL, any_hit),
        "ip": at("ip", text.rlike(r"[0-9]\.[0-9]"), IP, part_ok),
        "card": at("card", digit, CARD, lambda s: n_digits(s).between(16, 19) & luhn(digits_of(s["hit"]))),
        "phone": at("phone", text.rlike(r"\+[0-9]"), PHONE, lambda s: n_digits(s).between(8, 15)),
        "iban": at("iban", text.rlike("[A-Z]{2}[0-9]{2}"), IBAN, lambda s: mod97(s["hit"])),
        "token": at("token", digit, TOKEN, any_hit),
        "tel": at("tel", digit, LOCAL_PHONE, any_hit),
        "key": at("key", text.rlike(KEY_STARTS), KEY, any_hit),
        "private_key": at("private_key", F.contains(text, F.lit("-----BEGIN")), PRIVATE_KEY, any_hit),
        "secret": at("secret", text.rlike("(?i)pass|pwd|secret"), SECRET, any_hit),
        "base64": at("base64", text.rlike("[0-9A-Za-z+/_-]{32}"), BASE64, mixed),
    }


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one array column of (start, end, hit, score) for each kind, named pii_<kind>.

    Patterns propose spans; numbers of wrong length or checksum, and addresses with parts over 255, drop
    out; words on either side raise or lower the score, and kinds of the method's own need THRESHOLD of it. Null
    and empty texts have no spans; rows are independent, so repeated rows, null ids and ties need no rule; an
    empty table stays empty; a column of docs named pii_<kind> is replaced. Very long texts are searched whole.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = _spans(whole)
    return docs.withColumns({f"pii_{k}": found[k] for k in KINDS})


def op9_pii(spark, sf_dir):
    """Per row of documents: doc_id, spans of each base kind, their digest, all spans, and the number of all spans."""
    x = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    told = lambda k: F.transform(F.col(f"pii_{k}"), lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    joined = lambda kinds: F.array_join(F.concat(*[told(k) for k in kinds]), ",")
    return x.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(BASE_KINDS), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
        sum((F.size(f"pii_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_spans"),
    )
