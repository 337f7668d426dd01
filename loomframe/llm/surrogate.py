"""PII surrogates, in DataFrame functions only.

Detected entities get keyed replacements of the same type and format: a character-wise
Feistel network moves every character within its own alphabet (script, case, digits), so
the map is a permutation of each format: equal entities stay equal in the whole corpus
(coreference) and different ones stay different (distinctness).  Numbers keep their first digit and
whether their Luhn check digit holds; addresses stay valid addresses; mail domains keep
their last label and "example"; listed given names after a title move within the list of their gender, other names
keep script, case and the places of vowels.  Names without a title are not detected.

The collision check looks up all surrogates among all entities of the corpus:
a surrogate that is itself somebody's entity, or that two entities share, is drawn again with the next
key tweak until none is left, by joins and whatever their number.  From the draw after `ATTEMPTS` on, given names
leave their list (a list of 20 can be full), and from the one after `FORMAT_ATTEMPTS` on the format is given up for a
keyed token of 32 hex digits, as a format of which entities take more than half has no room.

The redrawn entities are put into the plan up to `EXCEPTIONS` of them and joined by text beyond.

Texts are shuffled only to meet more than `BROADCAST` redrawn entities: lines are cut at their entities and put together again by array functions.
Defined cases: a null text stays null; texts without an entity are returned unchanged, byte for
byte; repeated rows and equal entities get equal surrogates; extra columns
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "loomframe-surrogates"
EXCEPTIONS, ATTEMPTS, ROUNDS = 1_000, 4, 4
#: Draws within the format, and the largest table of redrawn entities that is broadcast.
FORMAT_ATTEMPTS, BROADCAST = 16, 100_000

#: Alphabets within which a character moves.
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
#: Of names, so that surrogates can be said: vowels move among vowels.
SPOKEN = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóú", "àèìòù", "äöü", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ",
    "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
HEX, UPPER_HEX, MIXED_HEX = ["0123456789abcdef"], ["0123456789ABCDEF"], ["0123456789", "abcdef", "ABCDEF"]
#: Given names by gender; a name moves within its list.
MALE = ["Adam", "Bernd", "Carlos", "David", "Emil", "François", "George", "Hans", "Ivan", "James", "Juan", "Karl", "Louis", "Michael", "Paul", "Peter", "Pierre", "Robert", "Thomas", "William"]
FEMALE = ["Alice", "Anna", "Camille", "Carmen", "Claire", "Elena", "Emma", "Greta", "Helga", "Isabel", "Jane", "Julia", "Laura", "Lucía", "Maria", "Marie", "Mary", "Sarah", "Sophie", "Susan"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = r"(?:Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Herrn?|Frau|Señora?|Sra?\.|Monsieur|Madame|Mme)"
#: Any case, with suffixes as in secret_access_key, secretKey and PASSWORD2, and as a quoted key.
_SECRET_WORD = r"(?i:password|passwd|pwd|secret|token|api[_\-]?key)(?i:access)?(?i:key|value|id)?\d{0,3}(?:[_\-][A-Za-z0-9_\-]{1,40})?"
_SECRET = rf"{_SECRET_WORD}[\"']?[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?"
_WORD = r"(?:\p{Lu}\p{Ll}+|\p{Lu}['’]\p{Lu}\p{Ll}+)(?:['’\-]?\p{Lu}\p{Ll}+)*"
#: (kind, pattern); the first that fits at a position wins.
PATTERNS = [
    ("mail", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"),
    # cheap tests of the neighbours stand before the wide look-behind
    ("secret", rf"(?<![A-Za-z0-9+/_\-])(?<=[=:\"' \t])(?=[A-Za-z0-9+/_\-]{{8}})(?<=[=:][ \t]{{0,3}}[\"']?)(?<={_SECRET})[A-Za-z0-9+/_\-]{{8,}}"),
    ("key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("address", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    ("phone", r"(?<!\d)(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}(?!\d)|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|(?<!\d)(?:(?<!\d[.\-])|(?<=\b1[.\-]))\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?!\d|[.\-]\d)|(?<!\d)\d{3} \d{3} \d{4}(?!\d)|(?<![\d\-])\d{3}-\d{4}(?![\d\-])"),
    ("social", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("number", r"(?<!\d)\d{4}(?:[ \-]\d{4}){3}(?!\d)|(?<!\d)\d{9,19}(?!\d)"),
    ("hex", r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]{32})(?=[A-Fa-f]*\d)[0-9A-Fa-f]{32,}(?![0-9A-Za-z])"),
    ("name", rf"(?<= )(?=\p{{Lu}}[\p{{Ll}}'’])(?<=\b{_TITLE} ){_WORD}(?:[ ]{_WORD})?"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What a line with an entity holds; entities do not cross line feeds.
HINT = r"[0-9@=:]|M(?:[rs]|iss|adame|onsieur|me)|Dr|Herr|Frau|S(?:eñor|ra?\.)"
MARK = "\u0001"


def _stream(key: Column, tag: Column, turn: Column, other: Column, size: Column) -> Column:
    """At least `size` keyed bytes in hex."""
    blocks = F.transform(F.sequence(F.lit(0), (size / 32).cast("int")), lambda c: F.sha2(F.concat_ws("|", key, tag, turn, c, other), 256))
    return F.array_join(blocks, "")


def _moved(text: Column, stream: Column, alphabets: list[str]) -> Column:
    """Each character moved within its alphabet by the stream's byte."""

    def one(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        k = F.conv(F.substr(stream, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for a in alphabets:
            at = F.instr(F.lit(a), c)
            out = F.when(at > 0, F.substr(F.lit(a), (at - 1 + k) % len(a) + 1, F.lit(1))).otherwise(out)
        return out

    n = F.length(text)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), "")).otherwise(F.lit(""))


def feistel(text: Column, key: Column, tag: Column, alphabets: list[str] | None = None) -> Column:
    """A keyed permutation of the strings of the text's format."""
    alphabets = alphabets or ALPHABETS
    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text) - half).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), _moved(s["l"], _stream(key, tag, i, s["r"], F.length(s["l"])), alphabets).alias("r"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _luhn(digits: Column) -> Column:
    """The check digit that would follow the digits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        d2 = F.when(i % 2 == 1, F.when(d >= 5, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + d2

    return (10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10) % 10


def _laid_out(digits: Column, form: Column) -> Column:
    """The digits put in the places of the digits of the form."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.length(form)),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, i: F.when(
            F.instr(F.lit(ALPHABETS[0]), F.substr(form, i, F.lit(1))) > 0,
            F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(s["out"], F.substr(form, i, F.lit(1))).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )
    return step


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(e: Column, key: Column) -> Column:
    def given(d: Column) -> Column:
        n = F.length(d)
        body, last = F.substr(d, F.lit(1), n - 1), F.substr(d, n, F.lit(1)).cast("int")
        new = F.concat(F.substr(d, F.lit(1), F.lit(1)), feistel(F.substr(d, F.lit(2), n - 2), key, F.lit("number")))
        return _let(new, lambda b: F.concat(b, ((_luhn(b) + last - _luhn(body) + 10) % 10).cast("string")))

    return _laid_out(_let(F.regexp_replace(e, "[^0-9]", ""), given), e)


def _phone(e: Column, key: Column) -> Column:
    """Keeps the country code."""
    code = F.regexp_extract(e, r"^(\+\d{1,3}[ .\-]?)?(.*)$", 1)
    rest = F.regexp_extract(e, r"^(\+\d{1,3}[ .\-]?)?(.*)$", 2)
    return F.concat(code, _laid_out(feistel(F.regexp_replace(rest, "[^0-9]", ""), key, F.lit("phone")), rest))


def _address(e: Column, key: Column) -> Column:
    """A permutation of the 32-bit addresses, by halves of 16 bits."""
    part = F.transform(F.split(e, r"\."), lambda p: p.cast("int"))

    def turn(s: Column, i: Column) -> Column:
        k = F.conv(F.substr(F.sha2(F.concat_ws("|", key, F.lit("address"), i, s["r"]), 256), F.lit(1), F.lit(4)), 16, 10).cast("int")
        return F.struct(s["r"].alias("l"), ((s["l"] + k) % 65536).alias("r"))

    def given(p: Column) -> Column:
        start = F.struct((p[0] * 256 + p[1]).alias("l"), (p[2] * 256 + p[3]).alias("r"))
        out = lambda s: F.concat_ws(".", F.shiftright(s["l"], 8), s["l"] % 256, F.shiftright(s["r"], 8), s["r"] % 256)
        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn, out)

    return _let(part, given)


def _mail(e: Column, key: Column) -> Column:
    local, domain = F.regexp_extract(e, "^(.*)@", 1), F.regexp_extract(e, "@(.*)$", 1)

    def labels(d: Column) -> Column:
        return F.array_join(F.transform(d, lambda x, i: F.when((i == F.size(d) - 1) | (x == "example"), x).otherwise(feistel(x, key, F.lit("domain")))), ".")

    return F.concat(feistel(local, key, F.lit("mail")), F.lit("@"), _let(F.split(domain, r"\."), labels))


def _name(e: Column, key: Column, listed_names: bool = True) -> Column:
    def word(w: Column) -> Column:
        out = feistel(w, key, F.lit("name"), SPOKEN)
        for names in (MALE, FEMALE) if listed_names else ():
            listed = F.array(*[F.lit(n) for n in names])
            at = F.array_position(listed, w)
            turn = F.conv(F.substr(F.sha2(F.concat_ws("|", key, F.lit("given")), 256), F.lit(1), F.lit(6)), 16, 10).cast("int") % (len(names) - 1) + 1
            out = F.when(at > 0, F.element_at(listed, ((at - 1 + turn) % len(names) + 1).cast("int"))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(e, " "), word), " ")


def kind_of(e: Column) -> Column:
    """The kind of an entity by its form alone."""
    full = [
        ("mail", r"^[^@\s]+@[^@\s]+$"),
        ("key", r"^AKIA[0-9A-Z]{16}$"),
        ("iban", r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"),
        ("address", rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"),
        ("number", r"^\d{4}(?:[ \-]\d{4}){3}$|^\d{9,19}$"),
        ("social", r"^\d{3}-\d{2}-\d{4}$"),
        ("phone", r"^[+(]|^\d{3}-\d{4}$|^\d{3}[ .\-]\d{3}[ .\-]\d{4}$"),
        ("hex", r"^[0-9a-f]*\d[0-9a-f]*$"),
        ("upper hex", r"^[0-9A-F]*\d[0-9A-F]*$"),
        ("mixed hex", r"^(?=.{32})[0-9A-Fa-f]*\d[0-9A-Fa-f]*$"),
        ("name", rf"^{_WORD}(?: {_WORD})?$"),
    ]
    out = F.lit("secret")
    for kind, p in reversed(full):
        out = F.when(e.rlike(p), kind).otherwise(out)
    return out


def surrogate(e: Column, key: Column, listed_names: bool = True) -> Column:
    """The keyed replacement of one entity; given names stay in their list if `listed_names`."""
    kind = kind_of(e)
    prefixed = lambda n, tag: F.concat(F.substr(e, F.lit(1), F.lit(n)), feistel(F.substr(e, F.lit(n + 1), F.length(e)), key, F.lit(tag)))
    return (
        F.when(kind == "mail", _mail(e, key))
        .when(kind == "key", prefixed(4, "key"))
        .when(kind == "iban", prefixed(2, "iban"))
        .when(kind == "address", _address(e, key))
        .when(kind == "number", _number(e, key))
        .when(kind == "phone", _phone(e, key))
        .when(kind == "hex", feistel(e, key, F.lit("hex"), HEX))
        .when(kind == "upper hex", feistel(e, key, F.lit("hex"), UPPER_HEX))
        .when(kind == "mixed hex", feistel(e, key, F.lit("hex"), MIXED_HEX))
        .when(kind == "name", _name(e, key, listed_names))
        .otherwise(feistel(e, key, F.lit("secret")))
    )


def _pieces(line: Column) -> Column:
    """A line cut at its entities: what lies between them at even places, entities at odd ones.

    One pass marks the entities; a line that holds the mark itself is cut by a second match.
    """
    marked = F.split(F.regexp_replace(line, PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    found = F.regexp_extract_all(line, F.lit(PATTERN), 0)
    zipped = F.flatten(F.zip_with(F.split(line, PATTERN, -1), found, lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))
    return F.when(F.contains(line, F.lit(MARK)), zipped).otherwise(marked)


def _found(text: Column) -> Column:
    """The entities of a text, with repeats."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(HINT))
    return F.flatten(F.transform(lines, lambda x: F.filter(_pieces(x), lambda p, i: i % 2 == 1)))


def entities(docs: DataFrame) -> DataFrame:
    """entity, texts: every distinct entity of all texts, and in how many it occurs."""
    found = docs.where(F.col("text").rlike(HINT)).select(F.explode(F.array_distinct(_found(F.col("text")))).alias("entity"))
    return found.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"))


def _clashes(drawn: DataFrame, taken: DataFrame) -> DataFrame:
    """Entities of (entity, new) whose `new` is among taken(new), or drawn for a smaller entity too."""
    both = drawn.select("new", "entity").unionByName(taken.select("new", F.lit(None).cast("string").alias("entity")))
    per = both.groupBy("new").agg(F.max(F.col("entity").isNull()).alias("taken"), F.array_sort(F.collect_list("entity")).alias("owners"))
    again = F.when(F.col("taken"), F.col("owners")).otherwise(F.filter("owners", lambda o, i: i > 0))
    return per.where(F.col("taken") | (F.size("owners") > 1)).select(F.explode(again).alias("entity"))


def _draw(e: Column, key: str, attempt: int) -> Column:
    """The surrogate of the given further attempt."""
    tweak = F.lit(f"{key}#{attempt}")
    if attempt > FORMAT_ATTEMPTS:
        return F.substr(F.sha2(F.concat_ws("|", tweak, e), 256), F.lit(1), F.lit(32))
    return surrogate(e, tweak, attempt <= ATTEMPTS)


def redrawn(docs: DataFrame, key: str = KEY) -> DataFrame:
    """entity, new: all entities whose first surrogate is taken, with one that nobody has.

    The entity table is reduced before any join; every round draws for all entities still open.
    """
    from .common import cut

    # few bytes but much work a row: a stated number of partitions is not coalesced
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = entities(docs).select("entity").repartition(tasks, "entity")
    made = cut(known.select("entity", surrogate(F.col("entity"), F.lit(key)).alias("new")))
    taken = made.select(F.col("entity").alias("new")).unionByName(made.select("new"))
    out = docs.sparkSession.createDataFrame([], "entity string, new string")
    open_ = cut(_clashes(made, made.select(F.col("entity").alias("new"))))
    n, attempt = open_.count(), 0
    while n:
        attempt += 1
        spread = open_.repartition(tasks, "entity") if n > EXCEPTIONS else open_.coalesce(1)
        trial = cut(spread.select("entity", _draw(F.col("entity"), key, attempt).alias("new")))
        open_ = cut(_clashes(trial, taken.unionByName(out.select("new"))))
        left = open_.count()
        if left < n:
            out = cut(out.unionByName(trial.join(open_, "entity", "left_anti")), n)
        n = left
    return out


def exceptions(docs: DataFrame, key: str = KEY) -> dict[str, str]:
    """`redrawn` as a dict, for tables that are known to be small."""
    return {r["entity"]: r["new"] for r in redrawn(docs, key).collect()}


def _lines(text: Column, key: str, other: dict[str, str] | Column | None) -> Column:
    """Array of (out, n): each line with its entities replaced, and their number."""
    if isinstance(other, Column):
        table = other
    else:
        table = F.create_map(*[F.lit(x) for pair in sorted((other or {}).items()) for x in pair]) if other else None

    def one(e: Column) -> Column:
        new = surrogate(e, F.lit(key))
        return F.coalesce(F.try_element_at(table, e), new) if table is not None else new

    def put_back(parts: Column) -> Column:
        out = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, one(p)).otherwise(p)), "")
        return F.struct(out.alias("out"), ((F.size(parts) - 1) / 2).cast("int").alias("n"))

    plain = lambda x: F.struct(x.alias("out"), F.lit(0).alias("n"))
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(HINT), _let(_pieces(x), put_back)).otherwise(plain(x)))


def replaced(text: Column, key: str = KEY, other: dict[str, str] | Column | None = None) -> Column:
    """(out, n): the text with every entity replaced in place, and their number; `other` maps redrawn entities."""
    whole = _let(_lines(text, key, other), lambda z: F.struct(F.array_join(z["out"], "\n").alias("out"), F.aggregate(z["n"], F.lit(0), lambda s, n: s + n).alias("n")))
    return F.when(text.rlike(HINT), whole).otherwise(F.struct(text.alias("out"), F.lit(0).alias("n")))


def _replaced_rows(docs: DataFrame, key: str) -> tuple[DataFrame, list[str], Column]:
    """All rows, their columns under free names (text as text), and `replaced` of their text."""
    names = ["text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]
    free = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names)])
    table = redrawn(docs, key)
    n = table.count()
    if n <= EXCEPTIONS:
        return free, names, replaced(F.col("text"), key, {r["entity"]: r["new"] for r in table.collect()})
    # the map of a text depends on the text alone, so rows need no key of their own
    digest_of = F.sha2(F.col("text"), 256)
    found = free.where(F.col("text").rlike(HINT)).select(digest_of.alias("_h"), F.explode(F.array_distinct(_found(F.col("text")))).alias("entity"))
    met = found.join(F.broadcast(table) if n <= BROADCAST else table, "entity").distinct()
    maps = met.groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("_other"))
    rows = free.withColumn("_h", digest_of).join(maps, "_h", "left")
    return rows, names, replaced(F.col("text"), key, F.col("_other"))


def anonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents (all columns) with surrogates in their texts."""
    rows, names, new = _replaced_rows(docs, key)
    return rows.select(*[(new["out"] if k == "text" else F.col(k)).alias(c) for c, k in zip(docs.columns, names)])


def digest(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text, n_entities of every document."""
    rows, names, new = _replaced_rows(docs.select("doc_id", "text"), key)
    made = rows.select(F.col(names[0]).alias("doc_id"), new.alias("z"))
    return made.select("doc_id", F.col("z.out").alias("text"), F.col("z.n").cast("long").alias("n_entities"))
