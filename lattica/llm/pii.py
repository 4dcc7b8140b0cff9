"""Surrogates for personal data, in DataFrame functions only.

E-mail addresses, telephone numbers, network addresses, card and social security numbers and titled names are found by
pattern and replaced by keyed surrogates of the same type and form: every digit becomes a digit, every letter a letter
of its case, an address part stays in 1..254, a card number that passes its check digit still does, a name keeps its
title, so its gender, and each of its words its script. Of an e-mail address only the last part of the host stays; of a
telephone number its country code.

One entity, however it is written, has one surrogate: the key stream depends on its normal form only. Names go word by
word, so ``Mr Smith`` and ``Mr John Smith`` share a surname, and a name's words are replaced in the rest of its document
too, where they stand without a title. Two entities have two surrogates: all distinct entities of the corpus are checked
for surrogates that coincide with one another's or with a real entity, and the later ones are keyed anew, names and
addresses with a longer form each time, until none does.

Not found: names that never stand with a title of the list, telephone numbers without country code, 3-3-4 layout or a
word like ``tel`` before them, card numbers of other than 16 digits whose check digit fails.

Defined results: a null text stays null and has no entity; a null doc_id keeps its row; repeated rows get equal
surrogates; extra columns are kept, but for one named ``entities``; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import cut, shuffle_width, table

# What an entity of each kind looks like, and titles by gender.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:(?:\d{4}[ -]?){3}\d{4}|\d{4}[ -]?\d{6}[ -]?\d{5}|\d{13,19})\b"
PHONE = (
    r"\+(?=\d(?:[ ().-]{0,2}\d){7,14}(?![ ().-]?\d))\d[\d ().-]{5,20}\d|(?:\(\d{3}\) ?|\b\d{3}[-. ])\d{3}[-. ]\d{4}\b"
    r"|\b(?=\d{8,12}\b)(?<=\b(?:tel|phone|mobile|fax|call|Tel|Phone|Mobile|Fax|Call)[.: ]{1,3})\d{8,12}"
)
ADDRESS = r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b"
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа", "Κυρία"]
MALE = ["Mr", "Herr", "Señor", "Monsieur", "Господин", "Κύριος"]
WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+"
NAME = r"\b(?:" + "|".join(FEMALE + MALE) + rf")\b\.? {WORD}(?: {WORD}){{0,3}}"
KINDS = {"email": EMAIL, "ssn": SSN, "card": CARD, "phone": PHONE, "ip": ADDRESS, "name": NAME}
ANY = f"{EMAIL}|(?=[+(0-9])(?:{SSN}|{CARD}|{PHONE}|{ADDRESS})|{NAME}"
ROUNDS, ALONE_AFTER = 64, 16
SYLLABLES = {
    "latin": (["ba", "de", "li", "mo", "ra", "ve", "ni", "to", "ka", "se", "lu", "pi", "jo", "ma", "re", "do"], ["na", "la", "ra", "ta"], ["n", "s", "r", "k"]),
    "cyrillic": (["ба", "де", "ли", "мо", "ра", "ве", "ни", "то", "ка", "се", "лу", "пи", "йо", "ма", "ре", "до"], ["на", "ла", "ра", "та"], ["н", "с", "р", "к"]),
    "greek": (["βα", "δε", "λι", "μο", "ρα", "βε", "νι", "το", "κα", "σε", "λου", "πι", "γιο", "μα", "ρε", "δο"], ["να", "λα", "ρα", "τα"], ["ς", "ν", "ρ", "ξ"]),
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _is_card(entity: Column) -> Column:
    digits = _digits(entity)
    return entity.rlike(f"^(?:{CARD})$") & ((F.length(digits) == 16) | (_luhn_sum(digits) % 10 == 0))


def kind_of(entity: Column) -> Column:
    """The kind of an entity, null for a long number that is none."""
    kind = F.when(F.contains(entity, F.lit("@")), "email").when(entity.rlike(r"^\p{L}"), "name").when(entity.rlike(f"^{SSN}$"), "ssn").when(entity.rlike(f"^{ADDRESS}$"), "ip")
    return kind.when(_is_card(entity), "card").when(F.length(_digits(entity)).between(7, 15) & ~entity.rlike(r"^\d{13,}$"), "phone")


def normal_form(entity: Column, kind: Column) -> Column:
    """What all writings of one thing share: digits of numbers (a telephone's last ten, but for foreign ones), lower case of the rest."""
    digits = _digits(entity)
    foreign = entity.startswith("+") & ~digits.startswith("1")
    return F.when(kind == "phone", F.when(foreign, digits).otherwise(F.right(digits, F.lit(10)))).when(kind.isin("card", "ssn"), digits).otherwise(F.lower(entity))


def _byte(stream: Column, i) -> Column:
    """The i-th byte of a hexadecimal key stream, which starts over after 64."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.substr(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).try_cast("int")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the check-digit rule over a whole number, its last digit included."""
    chars = _chars(digits)

    def weigh(c, i):
        v = c.try_cast("int") * F.when((F.size(chars) - i) % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(chars, weigh), F.lit(0), lambda a, x: a + x)


def _letters(stream: Column, n: Column) -> Column:
    """``n`` letters of the key stream, none for 0."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.char(97 + _byte(stream, i + 20) % 26)), "")).otherwise("")


def _mail(entity: Column, stream: Column, attempt: Column) -> Column:
    """Letters and digits moved within their class up to the last part of the host; each attempt adds a letter to the local part."""
    keep_from = F.length(F.regexp_extract(entity, r"^(.*)\.[^.]+$", 1))

    def move(c, i):
        b = _byte(stream, i)
        lower, upper = F.char(97 + (F.ascii(c) - 97 + b % 25 + 1) % 26), F.char(65 + (F.ascii(c) - 65 + b % 25 + 1) % 26)
        new = F.when(c.rlike("[0-9]"), ((F.ascii(c) - 48 + b) % 10).cast("string")).when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), upper).otherwise(c)
        return F.when(i < keep_from, F.when(c == "@", F.concat(_letters(stream, attempt), c)).otherwise(new)).otherwise(c)

    return F.array_join(F.transform(_chars(entity), move), "")


def _spread(entity: Column, digits: Column) -> Column:
    """``digits`` put where the entity has digits, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(acc, c):
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substr(digits, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["n"] + F.when(is_digit, 1).otherwise(0)).alias("n"))

    return F.aggregate(_chars(entity), start, put)["out"]


def _number(entity: Column, kind: Column, stream: Column) -> Column:
    """Digits moved by the key stream, counted from the right; a country code stays, and a right check digit is made right again."""
    digits = _digits(entity)
    n = F.length(digits)
    kept = F.when(kind != "phone", 0).when(entity.startswith("+") & ~digits.startswith("1"), 2).otherwise(F.greatest(n - 10, F.lit(0)))
    moved = F.array_join(F.transform(_chars(digits), lambda c, i: F.when(i < kept, c).otherwise(((c.try_cast("int") + _byte(stream, n - i)) % 10).cast("string"))), "")
    head = F.substr(moved, F.lit(1), n - 1)
    check = (10 - _luhn_sum(F.concat(head, F.lit("0"))) % 10) % 10
    right = F.when((kind == "card") & (_luhn_sum(digits) % 10 == 0), F.concat(head, check.cast("string"))).otherwise(moved)
    return _spread(entity, right)


def _name_word(word: Column, female: Column, stream: Column, attempt: Column) -> Column:
    """A word of syllables of the word's script with an ending by gender; ``female`` null gives it without, and each attempt adds a syllable."""

    def build(script):
        middle, woman, man = (F.array(*[F.lit(s) for s in part]) for part in SYLLABLES[script])
        pick = lambda part, i: F.element_at(part, _byte(stream, i) % F.size(part) + 1)
        more = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: pick(middle, i + 8)), "")).otherwise("")
        ending = F.when(female.isNull(), "").when(female, pick(woman, 5)).otherwise(pick(man, 5))
        return F.initcap(F.concat(*[pick(middle, i) for i in range(5)], more, ending))

    return _by_script(word, build)


def _by_script(word: Column, build) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), build("cyrillic")).when(word.rlike(r"\p{IsGreek}"), build("greek")).otherwise(build("latin"))


def parts_of(entity: Column) -> Column:
    """What of an entity has a surrogate of its own: ``(kind, norm, text, female)``; a name's words, all else whole, nothing of what has no kind.

    A given name is keyed with its gender; a surname, the last word, without: a family shares it, but for the ending.
    """
    kind = kind_of(entity)
    title = F.regexp_extract(entity, r"^(\p{L}+\.? )", 1)
    female = F.regexp_replace(title, r"[. ]", "").isin(FEMALE)
    words = F.split(F.substr(entity, F.length(title) + 1), " ")
    last = F.size(words) - 1

    def word(w, i):
        given = i < last
        norm = F.concat(F.when(~given, "").when(female, "f:").otherwise("m:"), F.lower(w))
        return F.struct(F.lit("name").alias("kind"), norm.alias("norm"), w.alias("text"), female.alias("female"))

    one = F.struct(kind.alias("kind"), normal_form(entity, kind).alias("norm"), entity.alias("text"), F.lit(None).cast("boolean").alias("female"))
    none = F.filter(F.array(one), lambda x: F.lit(False))
    return F.when(kind == "name", F.transform(words, word)).when(kind.isNotNull(), F.array(one)).otherwise(none)


def surrogate(part: Column, key: str, attempt: Column) -> Column:
    """The surrogate of one of ``parts_of``; ``attempt`` counts how often its former ones were taken."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), part["kind"], part["norm"], attempt.cast("string")), 512)
    with_stream = F.transform(F.array(F.struct(part.alias("p"), stream.alias("s"))), lambda x: _by_kind(x["p"], x["s"], attempt))  # one key stream a part
    return F.element_at(with_stream, 1)


def _by_kind(part: Column, stream: Column, attempt: Column) -> Column:
    kind, text = part["kind"], part["text"]
    address = F.array_join(F.transform(F.split(text, r"\."), lambda c, i: (1 + (c.try_cast("int") + _byte(stream, i)) % 254).cast("string")), ".")
    out = F.when(kind == "email", _mail(text, stream, attempt)).when(kind == "ip", address).when(kind == "name", _name_word(text, part["female"], stream, attempt))
    return out.otherwise(_number(text, kind, stream))


def _found(docs: DataFrame) -> DataFrame:
    """The distinct parts of all entities, one writing each."""
    hits = docs.where(F.col("text").rlike(ANY)).select(F.explode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("entity"))
    parts = hits.groupBy("entity").agg(F.lit(1).alias("one")).select(F.explode(parts_of(F.col("entity"))).alias("p"))
    return parts.groupBy("p.kind", "p.norm").agg(F.min("p.text").alias("text")).withColumn("female", F.lit(None).cast("boolean"))


def _given(kind: Column, text: Column, new: Column) -> Column:
    """The normal forms that a surrogate may show: a name's with every ending."""
    endings = _by_script(text, lambda script: F.array(*[F.lit(e) for part in SYLLABLES[script][1:] for e in part]))
    return F.when(kind == "name", F.transform(endings, lambda e: F.lower(F.concat(new, e)))).otherwise(F.array(normal_form(new, kind)))


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """``(kind, norm, attempt)`` of the parts whose first surrogate is another's, or is itself a real one; usually none.

    Should the numbers of a kind be so many that free ones run out, from round ``ALONE_AFTER`` on a surrogate only has
    to be nobody else's.
    """
    part = F.struct("kind", "norm", "text", "female")
    current = cut(_found(docs).repartition(shuffle_width(docs.sparkSession), "kind", "norm").withColumns({"attempt": F.lit(0), "again": F.lit(True), "new": F.lit("")}))
    for n in range(ROUNDS):
        current = cut(current.withColumn("new", F.when(F.col("again"), surrogate(part, key, F.col("attempt"))).otherwise(F.col("new"))))
        named = current.select("kind", "norm", "again", F.explode(_given(F.col("kind"), F.col("text"), F.col("new"))).alias("given"))
        clash = named.groupBy("kind", "given").agg(F.min(F.struct("again", "norm")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        real = current.select("kind", F.regexp_replace("norm", "^[fm]:", "").alias("given"), F.lit(True).alias("is_real")).distinct()
        met = named.join(clash, ["kind", "given"], "left").join(real, ["kind", "given"], "left")
        taken = F.coalesce("is_real", F.lit(False)) & (F.col("kind").isin("name", "email") | F.lit(n < ALONE_AFTER))
        late = met.where(F.coalesce(F.col("norm") != F.col("first.norm"), F.lit(False)) | taken).select("kind", "norm", F.lit(True).alias("late")).distinct()
        again = F.coalesce("late", F.lit(False))
        marked = current.drop("again").join(late, ["kind", "norm"], "left")
        marked = cut(marked.select("kind", "norm", "text", "female", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again"), "new"))
        if marked.where("again").isEmpty():
            break
        current = marked
    else:
        raise RuntimeError(f"surrogates still coincide after {ROUNDS} rounds")
    return cut(marked.where("attempt > 0").select("kind", "norm", "attempt"))


def replace_personal_data(docs: DataFrame, key: str = "lattica") -> DataFrame:
    """``docs`` with surrogates in ``text`` and the array ``entities`` of (kind, surrogate) in order of place."""
    fixes = collisions(docs, key)
    none = F.array().cast("array<string>")
    work = docs.withColumn("__hits", F.when(F.col("text").rlike(ANY), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none))
    attempt = lambda p: F.lit(0)
    if not fixes.isEmpty():
        row = {"__a": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__b": F.xxhash64("text")}
        hit = work.where(F.size("__hits") > 0).select(*[c.alias(n) for n, c in row.items()], F.explode("__hits").alias("e")).select("__a", "__b", F.explode(parts_of(F.col("e"))).alias("p"))
        hit = hit.select("__a", "__b", "p.kind", "p.norm").distinct().join(fixes, ["kind", "norm"])
        again = hit.groupBy("__a", "__b").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "norm"), "attempt"))).alias("__again"))
        work = work.withColumns(row).join(again, ["__a", "__b"], "left").drop("__a", "__b")
        attempt = lambda p: F.coalesce(F.try_element_at(F.col("__again"), F.concat_ws(":", p["kind"], p["norm"])), F.lit(0))

    def renewed(entity: Column) -> Column:
        parts = F.transform(parts_of(entity), lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"), surrogate(p, key, attempt(p)).alias("new")))
        return F.struct(entity.alias("entity"), parts.alias("parts"))

    work = work.withColumn("__items", F.transform("__hits", renewed))
    whole = lambda x: F.concat(F.when(x["entity"].rlike(r"^\p{L}+\.? "), F.regexp_extract(x["entity"], r"^(\p{L}+\.? )", 1)).otherwise(""), F.array_join(F.transform(x["parts"], lambda p: p["new"]), " "))
    item = lambda x: F.struct(F.try_element_at(x["parts"], F.lit(1))["kind"].alias("kind"), F.when(F.size(x["parts"]) == 0, x["entity"]).otherwise(whole(x)).alias("surrogate"))
    work = work.withColumn("__new", F.transform("__items", item))
    parts = F.arrays_zip(F.split("text", ANY, -1).alias("gap"), F.transform("__new", lambda x: x["surrogate"]).alias("new"))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(p["new"], F.lit("")))), "")
    words = F.array_distinct(F.flatten(F.transform("__items", lambda x: F.filter(x["parts"], lambda p: (p["kind"] == "name") & (F.length(p["text"]) > 2)))))
    edge = r"[\p{L}\p{M}]"
    text = F.aggregate(words, text, lambda t, w: F.regexp_replace(t, F.concat(F.lit(f"(?<!{edge})"), w["text"], F.lit(f"(?!{edge})")), w["new"]))
    out = work.withColumn("entities", F.filter("__new", lambda x: x["kind"].isNotNull())).withColumn("text", F.when(F.size("__hits") == 0, F.col("text")).otherwise(text))
    return out.select(*[c for c in docs.columns if c != "entities"], "entities")


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates, and how many entities of each kind it held."""
    found = replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long")
    return found.select("doc_id", "text", *[count(k).alias(f"n_{k}") for k in KINDS])
