"""Scalar operators on text columns (C1-C15): money, dates, references, types, headers.  All built-in, no Python."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, word lists and names below decide results and must be as they are.
CURRENCY = r"(?iU)(AED|SAR|USD|EUR|INR|GBP|Dhs?\.?|درهم|[£€₹$])"
REF_HINT = r"([A-Z]{2,}[-/#]?\d{3,}|\d{8}-\d{4,}|GKVW#\S+|PHUB\d+|[A-Z]+\d*[-/]\d+([-/]\d+)*|(?<![\d.,])0\d{6,}(?![\d.,])|(?<![\d.,/-])\d{2,4}/\d{2,4}/\d{3,}(?:/\d+)*(?![\d.,])|(?<![\d.,])\d{9,}(?![\d.,])|(?:INVOICE|INV|BILL|VOUCHER|DOC|REF|NO)\s*(?:NO)?[.#:\s]*\d{3,})"
NO_AMOUNT = ("", "-", "—", "–", "nil", "NIL")
TOTAL_ROW = r"\b(sub\s*-?\s*totals?|totals?|closing\s+balance|balance\s+(c/?f|carried)|grand\s+totals?|net\s+(balance|totals?|amount\s+due))\b"
OPENING_ROW = r"\b(opening\s+balance|balance\s+(b/?f|brought|as\s+(on|at))|bal\s+b/?f)\b"
REF_TYPES = ((r"^(CRT|CN|CRN)\b", "Credit Note"), (r"^(RVT|RCT|RCPT|PMT|PYMT)\b", "Payment"), (r"^(DBN|DN)\b", "Debit Note"))
TEXT_TYPES = ((r"\bpayment\b|\bpmt\b|\breceipt\b|\btrf\b|\btransfer\b", "Payment"), (r"credit\s*note|\bcn\b|\bcrn\b", "Credit Note"), (r"debit\s*note|\bdn\b", "Debit Note"), (r"\bbill\b", "Bill"))
PAYMENT_TYPES = ("payment", "payment made", "receipt")
HEADER_WORDS = {
    "date": ("date", "doc date", "document date", "txn date", "transaction date", "invoice date", "bill date", "posting date", "entry date"),
    "ref": (
        "reference", "ref", "ref no", "ref#", "reference number", "invoice", "invoice no", "invoice #", "inv no", "bill no", "bill number", "document",
        "document no", "doc no", "voucher", "voucher no", "number", "transaction#", "transaction no", "particulars ref",
    ),
    "type": ("type", "transaction type", "doc type", "document type", "txn type", "transaction"),
    "debit": ("debit", "debits", "debit amount", "dr", "dr amount", "invoice amount", "charges"),
    "credit": ("credit", "credits", "credit amount", "cr", "cr amount", "payment amount", "payments"),
    "amount": ("amount", "amount aed", "net amount", "value", "total", "total amount", "amount (aed)", "aed", "gross amount", "balance amount"),
    "desc": ("description", "narration", "details", "particulars", "memo", "remarks"),
}
ROLES = tuple(HEADER_WORDS)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Amounts without sign, mark or currency, which most are; what no amount holds: a character that is neither part of a number
#: nor taken off, or a minus right behind a digit (dates, references).
PLAIN_AMOUNT = r"^\d[\d,]*(\.\d+)?$"
NO_MONEY = rf"(?iU)[^\s0-9{EASTERN_DIGITS}()+\-.,AEDSRUINGBPHCدرهم£€₹$]|[0-9]-"
#: Digits with points and commas in which no run is as long as the shortest reference that is digits alone.
NO_REF = r"^(?:[0-9]{0,6}[.,])*[0-9]{0,6}$"


#: What every reference holds: a digit of any script or a "#" (so no other ASCII).
REF_MARK = r"""[^\x00-"$-/:-\x7F]"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once; else every use of it would repeat it.

    A fold over nothing: taking an item out of a transformed array asks for the type of the whole body at every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda worked_out, _: worked_out, body)


#: Amounts from here on are no money: their sums in cents would leave the whole numbers.
MOST_MONEY = 1e13


def finite(amount: Column) -> Column:
    """The amount, null where it is NaN, infinite or beyond MOST_MONEY."""
    return F.when(F.abs(amount) < MOST_MONEY, amount)


#: Text that has nothing to be stripped off: ASCII with a visible character at both ends.
STRIPPED = r"^[!-~](?:[ -~]*[!-~])?\z"


def strip(c: Column | str) -> Column:
    """Whitespace of any script off both ends."""
    whole = F.col(c) if isinstance(c, str) else c
    return let(whole, lambda s: F.when(s.rlike(STRIPPED), s).otherwise(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")))


def parse_amount(c: Column) -> Column:
    """Money text as a double, else null.  Text such as ``nan``, ``inf`` or ``1_000`` is null here."""
    mark = r"(?iU)\b(DR|CR)\b\.?$"

    def unmarked(x: Column) -> Column:
        bare = strip(F.translate(F.regexp_replace(F.regexp_replace(x["t"], mark, ""), CURRENCY, ""), ", ", ""))
        flips = x["n"] + F.when(F.upper(F.regexp_extract(x["t"], mark, 1)) == "CR", 1).otherwise(0)
        return let(F.struct(bare.alias("t"), flips.alias("n")), unsigned)

    def unsigned(x: Column) -> Column:
        minus = x["t"].startswith("-")
        digits = F.translate(F.when(minus, F.substr(x["t"], F.lit(2), F.length(x["t"]))).otherwise(x["t"]), EASTERN_DIGITS, "01234567890123456789")
        return let(F.struct(digits.alias("t"), ((x["n"] + minus.cast("int")) % 2).alias("n")), lambda y: F.when(y["t"].rlike(NUMBER), finite(y["t"].try_cast("double")) * (1 - 2 * y["n"])))

    def unwrapped(s: Column) -> Column:
        wrapped = s.startswith("(") & s.endswith(")") & (F.length(s) >= 2)
        inner = F.struct(F.when(wrapped, F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s).alias("t"), wrapped.cast("int").alias("n"))
        plain = finite(F.translate(s, ",", "").try_cast("double"))
        return F.when(s.rlike(PLAIN_AMOUNT), plain).when(s.rlike(f"[0-9{EASTERN_DIGITS}]") & ~s.rlike(NO_MONEY), let(inner, unmarked))

    return let(strip(c), unwrapped)


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), month, F.lit("-"), day).try_cast("date").cast("string")


def _year(text: Column) -> Column:
    """Two digits: 69-99 are of the last century."""
    return F.when(F.length(text) == 2, F.when(text >= "69", F.concat(F.lit("19"), text)).otherwise(F.concat(F.lit("20"), text))).otherwise(text)


def _month(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when((low == m) | (low == m[:3]), str(k + 1)) for k, m in enumerate(MONTHS)])


def parse_date_iso(c: Column) -> Column:
    """``yyyy-MM-dd`` of a date text, day before month, else null."""
    even = lambda s: F.when(s.rlike("  |[^ -~]"), F.regexp_replace(s, r"(?U)\s+", " ")).otherwise(s)
    return let(let(strip(c), even), lambda s: F.when(s.rlike(DATE_SHAPE), _parse_date(s)))


#: What all forms of dates have in common; most cells are none.
DATE_SHAPE = r"^[0-9A-Za-z]{1,9}[-/ ][0-9A-Za-z]{1,9}[-/, ]{1,2}\d{1,4}$"


def _parse_date(s: Column) -> Column:
    part = lambda p, k: F.regexp_extract(s, p, k)
    numeric, iso = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4}|\d{2})$", r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$"
    spaced, american, dashed = r"^(\d{1,2}) ([A-Za-z]{3,9}) (\d{4})$", r"^([A-Za-z]{3}) (\d{1,2}), (\d{4})$", r"^(\d{1,2})-([A-Za-z]{3})-(\d{4}|\d{2})$"
    return F.coalesce(
        F.when(s.rlike(numeric), _date(_year(part(numeric, 4)), part(numeric, 3), part(numeric, 1))),
        F.when(s.rlike(iso), _date(part(iso, 1), part(iso, 3), part(iso, 4))),
        F.when(s.rlike(spaced), _date(part(spaced, 3), _month(part(spaced, 2)), part(spaced, 1))),
        F.when(s.rlike(american), _date(part(american, 3), _month(part(american, 1)), part(american, 2))),
        F.when(s.rlike(dashed), _date(_year(part(dashed, 3)), _month(part(dashed, 2)), part(dashed, 1))),
    )


def _date_by_place(s: Column) -> Column:
    """``dd-mm-yyyy`` or ``dd/mm/yyyy``, told by where its digits are."""
    iso = F.concat(F.substr(s, F.lit(7), F.lit(4)), F.lit("-"), F.substr(s, F.lit(4), F.lit(2)), F.lit("-"), F.substr(s, F.lit(1), F.lit(2)))
    return F.when(s.rlike(r"^[0-9]{2}([-/])[0-9]{2}\1[0-9]{4}\z"), let(iso, lambda d: F.when(d.try_cast("date").isNotNull(), d)))


def parse_date(c: Column) -> Column:
    """struct(iso, raw); raw is the trimmed text, empty for null."""
    return F.struct(parse_date_iso(c).alias("iso"), F.coalesce(strip(c), F.lit("")).alias("raw"))


def excel_serial_date(d: Column) -> Column:
    """``yyyy-MM-dd`` of a number strictly between 20000 and 60000, else null."""
    return F.when((d > 20000) & (d < 60000), F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(d).cast("int")), "yyyy-MM-dd"))


def norm_ref(c: Column) -> Column:
    """C4: without whitespace, upper-cased, ``.,;:`` off both ends; null is empty."""
    dense = lambda s: F.when(s.rlike(r"^[!-~]+\z"), s).otherwise(F.regexp_replace(s, r"(?U)\s+", ""))
    return F.coalesce(F.regexp_replace(F.upper(let(c, dense)), r"^[.,;:]+|[.,;:]+$", ""), F.lit(""))


def looks_like_ref(c: Column) -> Column:
    """No date, and the reference pattern occurs somewhere."""
    return F.coalesce(parse_date_iso(c).isNull() & c.rlike("(?iU)" + REF_HINT), F.lit(False))


def extract_ref_token(c: Column) -> Column:
    """Of a text with a space or line break inside, the first reference in it if there is one."""

    def token(s: Column) -> Column:
        first = let(F.regexp_extract(s, "(?iU)" + REF_HINT, 0), lambda found: F.when(found != "", found).otherwise(s))
        return F.when((F.instr(s, " ") > 0) & (F.instr(strip(s), " ") > 0) | (F.instr(s, "\n") > 0), first).otherwise(s)

    return let(c, token)


def type_from_ref(ref: Column) -> Column:
    """The type that a reference's prefix tells, else null."""
    return F.coalesce(*[F.when(ref.rlike("(?iU)" + p), t) for p, t in REF_TYPES])


#: What a text must hold somewhere for one of TEXT_TYPES to be found; most hold none of it.
TYPE_WORDS = "payment|pmt|receipt|trf|transfer|credit|cn|crn|debit|dn|bill"


def infer_type(text: Column) -> Column:
    """The type that the words of a row tell; Invoice if none does."""
    tell = lambda low: F.when(low.rlike(TYPE_WORDS), F.coalesce(*[F.when(low.rlike("(?U)" + p), t) for p, t in TEXT_TYPES]))
    return F.coalesce(let(F.lower(text), tell), F.lit("Invoice"))


def _holds(text: Column, *words: str) -> Column:
    """Whether one of the words is anywhere in the text, by far the cheaper look."""
    return reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in words])


def is_total_row(text: Column) -> Column:
    """C9, on the joined text of a row."""
    return F.coalesce(_holds(text, "total", "balance", "amount") & text.rlike("(?iU)" + TOTAL_ROW), F.lit(False))


def is_opening_row(text: Column) -> Column:
    """C9, on the joined text of a row."""
    return F.coalesce(_holds(text, "bal") & text.rlike("(?iU)" + OPENING_ROW), F.lit(False))


def match_header(c: Column) -> Column:
    """The role of a header cell, else null: whole names first, then names at an end or as a word, by role."""
    words = F.trim(F.regexp_replace(F.lower(c), "[^a-z#()]+", " "))
    return F.when(c.rlike("[A-Za-z#()]|[^\\x00-\\x7F]"), let(words, lambda s: F.when(s != "", _role(s))))


def _role(s: Column) -> Column:
    exact = [F.when(s.isin(*names), role) for role, names in HEADER_WORDS.items()]
    partly = [F.when(s.rlike(_part_pattern(names)), role) for role, names in HEADER_WORDS.items()]
    # A name that is only a part leaves a space; without one it would be the whole text.
    return F.coalesce(*exact, F.when((F.length(s) > 2) & s.contains(" "), F.coalesce(*partly)))


def _part_pattern(names: tuple[str, ...]) -> str:
    """A name at the start, at the end, or as a word in the middle (names of one word only)."""
    any_of = lambda ns: "(?:" + "|".join(re.sub(r"([^a-z ])", r"\\\1", n) for n in ns) + ")"
    return f"^{any_of(names)} | {any_of(names)}$|(?:^| ){any_of([n for n in names if ' ' not in n])}(?: |$)"


def ref_alnum(c: Column) -> Column:
    """C11: upper-cased letters A-Z and digits."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^A-Z0-9]", "")


def ref_digits(c: Column) -> Column:
    """C11: digits only."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\D", "")


def ref_zstrip(c: Column) -> Column:
    """C11: digits without leading zeros; all zeros stay."""
    d = ref_digits(c)
    cut = F.regexp_replace(d, "^0+", "")
    return F.when(cut == "", d).otherwise(cut)


def one_typo(a: Column, b: Column) -> Column:
    """Same length of six or more, one place that differs."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    differ = F.size(F.filter(places, lambda k: F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1))))
    return F.coalesce((F.length(a) == F.length(b)) & (F.length(a) >= 6) & (differ == 1), F.lit(False))


def day_ordinal(iso: Column) -> Column:
    """y*372 + m*31 + d of the first ten characters, null unless they are three whole numbers."""
    parts = F.split(F.substr(iso, F.lit(1), F.lit(10)), "-")
    y, m, d = (F.trim(F.get(parts, F.lit(k))).try_cast("int") for k in range(3))
    return F.when(F.size(parts) == 3, y * 372 + m * 31 + d)


def is_payment(kind: Column) -> Column:
    """C14."""
    return F.coalesce(F.lower(strip(kind)).isin(*PAYMENT_TYPES), F.lit(False))


# Cells: struct<s string, d double, ts timestamp, i bigint>; a null or empty cell has none of them.


def number_text(d: Column) -> Column:
    """A double as a decimal number with at least one decimal place, never with an exponent."""
    fixed = F.regexp_replace(F.format_string("%.6f", d), r"0+$", "")
    return F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)


def cell_text(c: Column) -> Column:
    """Whole numbers have no decimal point, so that an invoice number stays one."""
    return F.coalesce(c["s"], c["i"].cast("string"), F.when(c["d"].isNotNull(), number_text(c["d"])), F.date_format(c["ts"], "yyyy-MM-dd HH:mm:ss"))


#: What most texts are.  Each is told by one look and needs no other: an amount in which no run of digits is long enough for a
#: reference; a reference with a letter that no currency has.
MONEY = r"^[0-9]{1,3}(?:,[0-9]{3}){0,4}(?:\.[0-9]{1,6})?\z"
REFERENCE = r"^(?=[A-Z]{2})[A-Z]*[FJKLMOQTVWXYZ][A-Z]*-[0-9]{3,}\z"


def _told_at_once(s: Column) -> Column:
    """What read_cell makes of a text that one look tells; null for all other texts."""

    def told(amt: Column | None = None, iso: Column | None = None, ref: bool = False, full: bool = True) -> Column:
        as_ = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
        return F.struct(s.alias("txt"), as_(amt, "double").alias("amt"), as_(iso, "string").alias("iso"), F.lit(ref).alias("ref"), F.lit(full).alias("full"))

    dashed = (F.length(s) == 10) & F.substr(s, F.lit(3), F.lit(1)).isin("-", "/")
    money = finite(F.translate(s, ",", "").try_cast("double"))
    number = let(F.when(dashed, _date_by_place(s)), lambda day: F.when(day.isNotNull(), told(iso=day)).when(s.rlike(MONEY), told(money)))
    return F.when(s == "", told(full=False)).when(F.ascii(s).between(48, 57), number).when(~s.rlike(REF_MARK), told()).when(s.rlike(REFERENCE), told(ref=True))


def read_cell(c: Column) -> Column:
    """struct(txt, amt, iso, ref, full): text, amount, ISO date, whether it looks like a reference, whether it is not empty."""
    number = F.coalesce(c["d"], c["i"].cast("double"))
    amt = F.coalesce(finite(number), F.when(c["s"].isNotNull(), parse_amount(c["s"])))

    def read(x: Column) -> Column:
        iso = F.coalesce(F.date_format(c["ts"], "yyyy-MM-dd"), excel_serial_date(number), x["dated"])
        hint = F.coalesce(x["dated"].isNull() & x["txt"].rlike(REF_MARK) & ~x["txt"].rlike(NO_REF) & x["txt"].rlike("(?iU)" + REF_HINT), F.lit(False))
        return F.struct(x["txt"].alias("txt"), amt.alias("amt"), iso.alias("iso"), hint.alias("ref"), (F.coalesce(x["txt"], F.lit("")) != "").alias("full"))

    whole = let(F.struct(cell_text(c).alias("txt"), F.when(c["s"].isNotNull(), parse_date_iso(c["s"])).alias("dated")), read)
    return F.coalesce(F.when(c["d"].isNull() & c["i"].isNull() & c["ts"].isNull(), _told_at_once(c["s"])), whole)


def is_blank_row(read: Column) -> Column:
    """C15, on an array of read cells."""
    return ~F.exists(read, lambda x: x["full"])


def has_signal(read: Column) -> Column:
    """C15, on an array of read cells: an amount or a date somewhere."""
    return F.exists(read, lambda x: x["amt"].isNotNull() | (x["full"] & x["iso"].isNotNull()))


def row_text(read: Column) -> Column:
    return F.array_join(F.transform(read, lambda x: x["txt"]), " ")
