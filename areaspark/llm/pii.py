"""Personal data and secrets replaced by surrogates of the same kind.

Entities are found by patterns: e-mail and IP addresses, phone, card, account and social security
numbers, secret tokens, and names after a form of address. Each gets a surrogate that follows
from a key and the entity's normal form, so the same entity has the same surrogate
everywhere, however it is written: layout, country code, checksum residue of card numbers,
letter case, script and, for given names, gender (from the form of address) stay as they were. Name
parts have their own surrogates, so that a surname alone still points to the same person.

Surrogates are checked over the whole corpus: if two entities share one, or one is an
entity of the corpus itself, the later one is drawn anew, from more surrogates each time, until none is left. Texts
without entities never move; the others are joined with their surrogates by digest.

Only built-in functions are used.

Cases: null texts stay null, empty ones empty; equal texts are worked off once; repeated rows
keep their rows; no rows give no rows; a text that consists of an entity alone is replaced
whole; columns other than the text stay as they are, whatever their names. Long texts are read whole; patterns start at
the start of a run of letters only, so long runs cost no more than their length.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.llm import common
from areaspark.session import keep as keep_table

# Forms of address with their gender, and names that are given out.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"]
GIVEN = {
    "m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Martin", "Nils", "Oscar", "Paul"],
    "f": ["Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Karin", "Laura", "Maria", "Nora", "Olivia", "Paula"],
}
GIVEN_CYRILLIC = {
    "m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Тимур"],
    "f": ["Алина", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София"],
}
SYLLABLES = ["ba", "do", "fe", "gu", "ha", "ke", "li", "mo", "na", "pe", "ra", "so", "ta", "ve", "wi", "zo"]
SYLLABLES_CYRILLIC = ["ба", "до", "фе", "гу", "ха", "ке", "ли", "мо", "на", "пе", "ра", "со", "та", "ве", "ви", "зо"]

#: Country codes of phone numbers; none starts another.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

# Words inside names that stay as they are.
PARTICLES = ["van", "von", "vom", "der", "den", "de", "del", "della", "di", "da", "dos", "das", "do", "du", "des", "la", "le", "ten", "ter", "te", "zu", "zum", "zur", "und", "af", "av", "bin", "bint", "ibn", "al", "el", "y", "e"]
TITLES = ["Dr", "Prof", "Rev", "Hon", "Ing", "Dipl", "Mag", "St"]
SUFFIXES = ["Jr", "II", "III", "IV"]
INITIALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"

_EDGE, _STOP = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FORM = "|".join(sorted(MALE + FEMALE, key=len, reverse=True))
_INITIAL = r"\p{Lu}\.(?:-\p{Lu}\.)*+"
_PARTICLE = "(?:" + "|".join(sorted(PARTICLES, key=len, reverse=True)) + ")"
_WORD = r"(?:[dl]['’]|(?:al|el)-)?\p{Lu}[\p{L}\p{M}]*+(?:(?:['’](?!s(?!\p{L}))|-)[\p{L}\p{M}]++)*+"
#: Words of a name: particles, then an initial, a title or a capitalised word that is no form of address.
_PART = "(?:" + _PARTICLE + " ){0,3}+(?!(?:" + _FORM + r")(?![\p{L}\p{N}]))(?:(?:" + "|".join(TITLES) + r")\.|" + _INITIAL + "|" + _WORD + ")"
#: Kinds in order of precedence, each with the pattern of its entities.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}._+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)+",
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _STOP,
    "token": r"(?<![0-9A-Za-z_-])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb|xoxp)[_-][0-9A-Za-z_-]{16,}+)(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])" + _BYTE + r"(?:\." + _BYTE + r"){3}(?![0-9A-Za-z])(?!\.\d)",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}" + _STOP
    + r"|(?<![0-9A-Za-z+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]\d{2,4}){3,5}" + _STOP + r"|(?<![0-9A-Za-z.+-])0\d(?:[ .-]\d{2}){4}" + _STOP + r"(?![ .-]\d)"
    + r"|(?<![0-9A-Za-z.+-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + _STOP,
    "card": _EDGE + r"\d(?:[ -]?\d){12,18}" + _STOP,
    "name": r"(?=\p{L})(?<=[\p{L}.] )(?<=(?<![\p{L}\p{N}])(?:" + _FORM + r")\.? )" + _PART + r"(?:(?: |(?<=\.))" + _PART + ")*+",
}
# No entity starts inside a run of ASCII letters and digits: most places are passed over at once.
PATTERN = r"(?<![0-9A-Za-z])(?=[\p{L}\p{N}+(._-])(?:" + "|".join(KINDS.values()) + ")"


def _hint(text: Column) -> Column:
    """What a text with an entity holds at least, found without alternatives at every place."""
    hint = text.rlike("[0-9@]|(?:sk|pk|ghp|gho|xoxb|xoxp)[_-][0-9A-Za-z_-]{16}|[a-f]{32}|[A-F]{32}|AKIA")
    for form in MALE + FEMALE:
        hint = hint | text.contains(form)
    return hint


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte of a hex stream of 64 bytes, from 0."""
    return F.conv(F.substr(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")).cast("binary"), 512)


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _range(code: int, n: int, b: Column) -> Column:
    return F.substr(F.lit("".join(chr(code + k) for k in range(n))), F.pmod(b, F.lit(n)) + 1, F.lit(1))


def _like(text: Column, stream: Column) -> Column:
    """Letters and digits replaced by others of the same script, case and kind."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        out = F.when(c.between("0", "9"), _range(48, 10, b)).when(c.between("a", "z"), _range(97, 26, b)).when(c.between("A", "Z"), _range(65, 26, b))
        out = out.when(c.between("а", "я"), _range(0x430, 32, b)).when(c.between("А", "Я"), _range(0x410, 32, b))
        out = out.when(c.between("α", "ω"), _range(0x3B1, 17, b)).when(c.rlike(r"^\p{Lu}$"), _range(65, 26, b)).when(c.rlike(r"^\p{L}$"), _range(97, 26, b))
        return out.otherwise(c)

    return F.array_join(F.transform(_letters(text), one), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Checksum of a digit string, modulo 10."""
    values = F.transform(F.reverse(_letters(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10


def _kind(value: Column) -> Column:
    def whole(pattern: str) -> str:
        return f"^(?:{pattern})$"

    out = F.when(value.contains("@"), "email").when(value.rlike(whole(r"\d{1,3}(?:\.\d{1,3}){3}")), "ip").when(value.rlike(whole(r"\d{3}-\d{2}-\d{4}")), "ssn")
    out = out.when(value.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb|xoxp)[_-].*)$"), "token")
    out = out.when(value.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(~value.rlike(r"\d"), "name")
    return out.when(value.rlike(r"[+(]") | (F.length(_digits(value)) < 13), "phone").otherwise("card")


def _initials(key: str, raw: Column) -> Column:
    """Initials moved on in their alphabet by a number from the key: different ones stay different."""
    move = int(hashlib.sha512(f"{key}|initials".encode()).hexdigest(), 16)
    moved = "".join(a[n:] + a[:n] for a in INITIALS for n in [1 + move % (len(a) - 1)])
    return F.translate(F.regexp_replace(raw, rf"[\p{{Lu}}&&[^{''.join(INITIALS)}]]", "X"), "".join(INITIALS), moved)


def _parts(value: Column, form: Column) -> Column:
    """An entity as parts, each with kind, normal form and letters as written. Given names carry the gender of the form of address."""
    kind = _kind(value)
    word = lambda k, w: F.struct(k.alias("kind"), F.lower(F.rtrim(w)).alias("norm"), w.alias("raw"))
    gender = F.when(form.isin(*FEMALE), "f").otherwise("m")
    # words keep the blank behind them
    words = F.split(value, r"(?<= )|(?<=\.)(?=\p{L})")
    fixed = "^(?:" + "|".join(PARTICLES + [rf"{t}\." for t in TITLES] + SUFFIXES) + ") ?$"
    short = F.transform(words, lambda w: F.when(w.rlike(fixed), "fixed").when(w.rlike(rf"^(?:{_INITIAL}|\p{{Lu}}) ?$"), "initial").otherwise("word"))
    last = F.size(words) - F.array_position(F.reverse(short), "word")
    name = F.zip_with(words, F.transform(short, lambda s, i: F.when(s != "word", s).when(i == last, "surname").otherwise(F.concat(F.lit("given_"), gender))), lambda w, k: word(k, w))
    phone = F.concat(F.when(value.startswith("+"), "+").otherwise(""), _digits(value))
    norm = F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), _digits(value)).when(kind == "iban", F.regexp_replace(value, " ", ""))
    norm = norm.when(kind == "email", F.lower(value)).otherwise(value)
    return F.when(kind == "name", name).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"), value.alias("raw"))))


def _surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The normal form of the surrogate of a normal form."""
    stream = _stream(key, kind, norm, attempt)
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), F.pmod(_byte(stream, F.lit(i)), F.lit(len(words))) + 1)
    digits = _like(norm, stream)
    code = F.regexp_extract(norm, COUNTRY, 0)
    phone = F.concat(code, F.substr(digits, F.length(code) + 1))
    last = F.pmod(F.right(digits, F.lit(1)).cast("int") + _luhn(norm) - _luhn(digits), F.lit(10))
    card = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), last.cast("string"))
    octets = F.concat_ws(".", *[(_byte(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    local = _like(F.substring_index(norm, "@", 1), stream)
    mail = F.concat(local, F.lit("@"), F.lower(F.substr(stream, F.lit(100), F.lit(8))), F.lit(".example.org"))
    iban = F.concat(F.substr(norm, F.lit(1), F.lit(2)), _like(F.substr(norm, F.lit(3)), stream))
    # tokens may be long: every 64 characters have a stream of their own, worked out once
    blocks = lambda text, one: common.let(stream, lambda s: F.array_join(F.transform(F.regexp_extract_all(text, F.lit(".{1,64}"), F.lit(0)), lambda c, i: common.let(
        F.when(i == 0, s).otherwise(F.sha2(F.concat_ws("|", s, i.cast("string")).cast("binary"), 512)), lambda t: one(c, t))), ""))
    hexes = blocks(norm, lambda c, s: F.substr(s, F.lit(1), F.length(c)))
    token = F.when(norm.rlike("^[0-9a-f]+$"), hexes).when(norm.rlike("^[0-9A-F]+$"), F.upper(hexes))
    token = token.otherwise(F.concat(F.substr(norm, F.lit(1), F.lit(4)), blocks(F.substr(norm, F.lit(5)), _like)))
    cyrillic = norm.rlike(r"^\p{IsCyrillic}")
    # every redraw adds a syllable or an initial, so that there are surrogates for any number of names
    again = F.when(attempt > 0, F.sequence(F.lit(1), attempt)).otherwise(F.array().cast("array<int>"))
    added = lambda one: F.array_join(F.transform(again, lambda i: one(_byte(stream, i + 8))), "")
    syllable = lambda words: lambda b: F.element_at(F.array(*map(F.lit, words)), F.pmod(b, F.lit(len(words))) + 1)
    longer = lambda words: F.concat(*[pick(words, i) for i in range(4)], added(syllable(words)))
    family = F.when(cyrillic, longer(SYLLABLES_CYRILLIC)).otherwise(longer(SYLLABLES))
    more = added(lambda b: F.concat(F.lit(" "), _range(65, 26, b), F.lit(".")))
    given = lambda g: F.when(cyrillic, F.concat(F.lower(pick(GIVEN_CYRILLIC[g], 0)), more)).otherwise(F.concat(F.lower(pick(GIVEN[g], 0)), more))
    out = F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", digits).when(kind == "ip", octets).when(kind == "email", mail)
    return out.when(kind == "iban", iban).when(kind == "token", token).when(kind == "surname", family).when(kind == "given_m", given("m")).otherwise(given("f"))


def _written(kind: Column, raw: Column, sur: Column) -> Column:
    """A surrogate in the layout and case of the entity it stands for."""
    signs = F.regexp_replace(sur, r"^\+", "")
    fill = F.aggregate(
        _letters(raw),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(s["out"], F.substr(signs, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))
        ),
        lambda s: s["out"],
    )
    cased = F.when(F.upper(raw) == raw, F.upper(sur)).when(F.lower(raw) == raw, F.lower(sur))
    named = F.concat(cased.otherwise(F.initcap(sur)), F.when(raw.endswith(" "), " ").otherwise(""))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), fill).when(kind.isin("ip", "token"), sur).when(kind == "email", cased.otherwise(sur)).otherwise(named)


def _resolved(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, raw and ``attempt``: how often the surrogate was drawn anew.

    ``entities`` has one row for each (kind, norm). A surrogate belongs to the entity that
    took it first; one that is itself an entity of the corpus belongs to nobody.
    """
    now = keep_table(entities.withColumn("attempt", F.lit(0)), "entities")
    while True:
        drawn = now.withColumn("sur", _surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt")))
        owner = drawn.groupBy("kind", "sur").agg(F.min(F.struct("attempt", "norm")).alias("owner"), F.count("*").alias("n"))
        real = now.select("kind", F.col("norm").alias("sur"), F.lit(True).alias("real"))
        owner = owner.join(real, ["kind", "sur"], "left").where((F.col("n") > 1) | F.col("real"))
        judged = drawn.join(owner, ["kind", "sur"], "left")
        loses = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("owner.norm") != F.col("norm"), F.lit(False))
        after = keep_table(judged.select("kind", "norm", "raw", (F.col("attempt") + loses.cast("int")).alias("attempt"), loses.alias("again")), "entities")
        now = after.drop("again")
        if not after.where("again").limit(1).count():
            return now


def replace(df: DataFrame, text: str = "text", key: str = "surrogates", count: str | None = None) -> DataFrame:
    """The frame with the entities of its text column replaced; ``count`` names a column for their number."""
    common.needs(df, [text])
    if count is not None and count in df.columns:
        raise ValueError(f"there is a column {count} already")
    columns = df.columns
    # everything else travels as one column, so that no name can clash
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), df[text].alias("t"))
    base = base.withColumn("values", F.when(_hint(F.col("t")), F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0))))
    base = base.withColumn("n", F.coalesce(F.array_size("values"), F.lit(0)))

    def told(frame: DataFrame, new: Column) -> DataFrame:
        out = [new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns]
        return frame.select(*out, *([F.col("n").cast("long").alias(count)] if count else []))

    found = keep_table(base.where("n > 0").withColumn("digest", F.md5(F.col("t").cast("binary"))), "found")
    pieces = F.split("t", PATTERN, -1)
    texts = found.select("digest", "values", pieces.alias("pieces")).dropDuplicates(["digest"])
    said = texts.select("digest", F.posexplode("values").alias("at", "value"), "pieces")
    form = F.regexp_extract(F.get("pieces", F.col("at")), rf"(?<![\p{{L}}\p{{N}}])({_FORM})\.? $", 1)
    said = said.select("digest", "at", F.posexplode(_parts(F.col("value"), form)).alias("k", "part"))
    said = keep_table(said.select("digest", "at", "k", "part.kind", "part.norm", "part.raw"), "said")
    # initials and fixed words are no entities by themselves
    alone = F.col("kind").isin("fixed", "initial")
    entities = _resolved(said.where(~alone).groupBy("kind", "norm").agg(F.min("raw").alias("raw")), key)
    # the surrogate without a redraw follows from the entity alone
    redrawn = entities.where("attempt > 0").select("kind", "norm", "attempt")
    said = said.join(redrawn, ["kind", "norm"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    said = said.withColumn("sur", _surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt")))
    new = F.when(F.col("kind") == "fixed", F.col("raw")).when(F.col("kind") == "initial", _initials(key, F.col("raw")))
    said = said.select("digest", "at", "k", new.otherwise(_written(F.col("kind"), F.col("raw"), F.col("sur"))).alias("new"))
    rank = F.array_sort(F.collect_list(F.struct("at", "k", "new")))
    new = said.groupBy("digest").agg(rank.alias("new"))
    joined = found.join(new, "digest").withColumn("pieces", pieces)
    # words of a name follow each other, entities stand between the pieces
    ahead = F.transform("new", lambda x: F.when(x["k"] > 0, x["new"]).otherwise(F.concat(F.get("pieces", x["at"]), x["new"])))
    text_of = F.concat(F.array_join(ahead, ""), F.element_at("pieces", -1))
    return told(base.where("n = 0"), F.col("t")).unionByName(told(joined, text_of))
