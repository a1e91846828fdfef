"""Operator 6: personal data replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .shared import cut, slices, unused

#: The session's setting that holds the key. Where it is unset every run draws a key of its own, which nobody can invert.
KEY_SETTING = "spark.foliate.pii.key"
#: From this draw on surrogates are of wider formats, wider with every draw, so that no format can run out.
WIDEN = 4

GIVEN = {
    ("latin", "f"): "Priya Ananya Lakshmi Sunita Fatima Aisha Leila Yasmin Amina Zainab Ngozi Chiamaka Amara Mei Xiaoling Yuki Sakura Hanako Jiwoo Linh Olivia Charlotte Amelia Mia Harper Evelyn Grace Chloe Lily Nora Hannah Lena Katharina Julia Franziska Petra Chantal Amélie Léa Manon Inès Sofía Valentina Camila Gabriela Daniela Marta Giulia Chiara Francesca Agnieszka Katarzyna Mary Patricia Linda Barbara Elizabeth Jennifer Susan Margaret Dorothy Helen Sandra Carol Ruth Sharon Michelle Laura Sarah Deborah Jessica Amy Anna Emma Sophie Julie Claire Isabel Lucia Carmen Elena Ingrid Monika Heike Sabine Nathalie Camille Pilar".split(),
    ("latin", "m"): "Rahul Arjun Vikram Sanjay Mohammed Muhammad Ahmed Omar Hassan Yusuf Ibrahim Chinedu Kwame Wei Jian Hiroshi Takeshi Kenji Minjun Liam Noah Oliver Benjamin Lucas Henry Alexander Jack Samuel Nathan Ethan Felix Lukas Jonas Maximilian Florian Wolfgang Dieter Thierry Olivier Mathieu Baptiste Alejandro Fernando Rafael Sergio Matteo Lorenzo Giovanni Piotr Krzysztof Andrzej James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Paul Andrew Kenneth George Edward Brian Kevin Peter Klaus Jürgen Hans Stefan Pierre Jacques Antoine Luis Carlos Miguel Javier Diego Walter Henri".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила Галина Юлия".split(),
    ("cyrillic", "m"): "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Павел Юрий Борис".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Βασίλης Χρήστος Αθανάσιος".split(),
}
HONORIFICS = {**dict.fromkeys("Mr Sir Herr Monsieur Señor Don г-н господин Κύριος".split(), "m"), **dict.fromkeys("Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Doña г-жа госпожа Κυρία".split(), "f"), **dict.fromkeys("Dr Prof".split(), "")}
SURNAME = {
    "latin": ("Al Bar Cor Dal El Fair Gar Hal Ken Lan Mar Nor Or Pel Quin Ros Sal Tar Val Wes Bren Clar Dun Hol".split(), "ber combe der den field ford ham hurst ker land ley low man mer mond ner ridge sen son stock ton vale well wood".split()),
    "cyrillic": ("Бел Вол Гор Дан Ел Жар Зор Кар Лад Мар Нов Ор Пет Род Сол Тар".split(), "ганов денко дин жин зин ин ков левич манов ников пов рин сов тин ук ченко".split()),
    "greek": ("Αλεξ Βασ Γεωργ Δημ Ευαγγ Θεοδ Καρ Λαμπ Μιχ Νικ Παπ Στεφ".split(), "άκης ίδης όπουλος έας άτος ιάδης ούδης άρης".split()),
}
GENDER = {n.casefold(): (s, g) for (s, g), names in GIVEN.items() for n in names}

_CAP = r"[A-ZÀ-ÖØ-ÞΑ-ΩΆΈΉΊΌΎΏА-ЯЁ][^\W\d_]+(?:-[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][^\W\d_]+)?"
_NAMES = sorted({x for names in GIVEN.values() for n in names for x in (n, n.upper())}, key=len, reverse=True)
_TITLES = sorted(HONORIFICS, key=len, reverse=True)
_SAID = "my name is|mein Name ist|ich heiße|je m'appelle|je m’appelle|mon nom est|me llamo|mi nombre es|меня зовут|με λένε".split("|")
_SAID += [x[0].upper() + x[1:] for x in _SAID]
_FIRST, _CAPITALS = ("".join(sorted({x[0] for x in of})) for of in ([*_TITLES, *_SAID], _NAMES))
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[A-Za-z0-9_.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-]))"
    r"|(?=[A-Z])(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?=[0-9A-Fa-f:])(?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|(?=::)):[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*+(?![\w:]))"
    r"|(?=\d)(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?=\d)(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w]|-\d))"
    r"|(?=\d)(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?=[\d+(])(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w]|-\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\w]|-\d))"
    rf"|(?=[{_FIRST}])(?<![^\W\d_])(?:(?P<title>{'|'.join(map(re.escape, _TITLES))})(?:\. ?| )|(?P<said>{'|'.join(map(re.escape, _SAID))}) )(?P<one>{_CAP})(?: (?P<two>{_CAP}))?(?![^\W\d_])"
    rf"|(?=[{_CAPITALS}])(?<![^\W\d_])(?P<given>{'|'.join(map(re.escape, _NAMES))})(?: (?P<family>{_CAP}))?(?![^\W\d_])"
)
#: What a text with an entity has: an address sign, two near colons, enough digits, a listed name, a title or an introduction.
_DIGITS = r"[\d+](?:(?<=\+)\d|(?<=\d)(?:\.\d{1,3}\.\d|(?:[ .()-]{0,3}\d){7}))"
_ANY_DIGITS, _ASCII_DIGITS = re.compile(_DIGITS), re.compile(_DIGITS, re.ASCII)
_COLONS, _BANK = re.compile(r":[0-9A-Fa-f]{0,4}:"), re.compile(r"[A-Z][A-Z]\d\d")
_LISTED = frozenset([*_NAMES, *(t for t in _TITLES if t[0].isupper())])
_LEADING = re.compile(rf"[{''.join(sorted({x[0] for x in _LISTED}))}][^\W\d_]+")
_PHRASES = [x for x in [*_SAID, *_TITLES] if x not in _LISTED]


def maybe(text: str) -> bool:
    """False only if the text has no entity; cheap."""
    if "@" in text or _BANK.search(text) or (_ASCII_DIGITS if text.isascii() else _ANY_DIGITS).search(text) or ":" in text and _COLONS.search(text):
        return True
    return not _LISTED.isdisjoint(_LEADING.findall(text)) or any(x in text for x in _PHRASES)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script(name: str) -> str:
    c = max(name, key=str.isalpha)
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, canonical form) of each entity, from left to right; mentions of one entity have one form."""
    out = []
    if not text or not maybe(text):
        return out
    for m in PATTERN.finditer(text):
        kind, s = m.lastgroup, m.group()
        if m["one"]:
            gender = HONORIFICS[m["title"]] if m["title"] else ""
            parts = [("one", "given"), ("two", "surname")] if m["two"] else [("one", "surname" if m["title"] else "given")]
            for group, what in parts:
                known = GENDER.get(m[group].casefold())
                if what == "given" or known:
                    what = "given:" + (known[1] if known else gender or "n")
                out.append((*m.span(group), what, m[group].casefold()))
        elif m["given"]:
            out.append((*m.span("given"), "given:" + GENDER[m["given"].casefold()][1], m["given"].casefold()))
            if m["family"]:
                out.append((*m.span("family"), "surname", m["family"].casefold()))
        elif m["email"]:
            out.append((*m.span(), "email", s.lower()))
        elif m["ipv6"]:
            if s.count(":") < 8 and any(map(str.isdigit, s)) and sum(map(bool, s.split(":"))) > 2:
                try:
                    out.append((*m.span(), "ipv6", str(ipaddress.IPv6Address(s))))
                except ValueError:
                    pass
        elif m["ip"]:
            if all(int(x) < 256 for x in s.split(".")):
                out.append((*m.span(), "ip", ".".join(str(int(x)) for x in s.split("."))))
        elif m["card"]:
            digits = _ascii(re.sub(r"\D", "", s))
            if luhn(digits) and len(set(digits)) > 1:
                out.append((*m.span(), "card", digits))
        elif m["iban"]:
            plain = s.replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain) == 1:
                out.append((*m.span(), "iban", plain))
        elif kind in ("ssn", "phone"):
            out.append((*m.span(), kind, _ascii(re.sub(r"[^\d+]", "", s))))
    return out


def _ascii(digits: str) -> str:
    """Digits of any script as ASCII ones."""
    return digits if digits.isascii() else "".join(c if c == "+" else str(unicodedata.digit(c)) for c in digits)


class Draws:
    """A keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: str, *about: str | int):
        self.seed, self.at, self.pool = "\x1f".join(map(str, about)).encode(), 0, 0
        self.key, self.left = key.encode()[:64], 0

    def below(self, n: int) -> int:
        if self.left < n * 2**20:
            self.at += 1
            self.pool = int.from_bytes(hashlib.blake2b(self.seed + self.at.to_bytes(4, "big"), key=self.key, digest_size=64).digest(), "big")
            self.left = 2**512
        self.pool, r = divmod(self.pool, n)
        self.left //= n
        return r

    def like(self, s: str) -> str:
        """Letters for letters of the same case, digits for digits, the rest as it is."""
        return "".join(str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if c.islower() else chr(65 + self.below(26)) if c.isupper() else c for c in s)


def surrogate(kind: str, canon: str, attempt: int, key: str) -> str:
    """The canonical form of the attempt-th replacement of an entity; from WIDEN on its format widens with each attempt."""
    d = Draws(key, kind, canon, attempt)
    wide = max(0, attempt - WIDEN + 1)
    if kind == "email":
        local, _, domain = canon.partition("@")
        *labels, top = domain.split(".")
        there = Draws(key, "domain", domain)  # one domain for all its mailboxes
        return d.like(local) + d.like("a0" * wide) + "@" + ".".join([there.like(x) for x in labels] + [top])
    if kind == "ipv6" or kind == "ip" and wide > 12:
        groups = canon.split(":") if kind == "ipv6" else ["2001", "db8", "", "0000"]
        fixed = kind == "ip" or ipaddress.IPv6Address(canon).is_private  # the documentation's prefix; private ones stay private
        drawn = [x if not x or fixed and k < 1 + (kind == "ip") else "%x" % (16 ** (len(x) - 1) + d.below(15 * 16 ** (len(x) - 1))) for k, x in enumerate(groups)]
        if wide and (spare := next((k for k, x in enumerate(drawn) if k and not x), 0)):
            drawn[spare : spare + 1] = ["", *("%x" % (1 + d.below(65535)) for _ in range(min(wide, 9 - len([x for x in drawn if x]) - 2)))]
        elif wide:
            drawn = [x if fixed and not k else "%x" % (1 + d.below(65535)) for k, x in enumerate(drawn)]
        return str(ipaddress.IPv6Address(":".join(drawn)))
    if kind == "ip":
        if ipaddress.ip_address(canon).is_private and not wide:
            fixed = canon.split(".")[: 1 if canon.startswith(("10.", "127.")) else 2]
        else:
            fixed = []
            while not fixed or (fixed[0] in (10, 127) or fixed[:2] in ([192, 168], [169, 254], [198, 18]) or fixed[0] == 172 and 16 <= fixed[1] < 32):
                fixed = [1 + d.below(223), d.below(256)]
        return ".".join(map(str, [*fixed, *(d.below(256) for _ in range(3 - len(fixed))), 1 + d.below(254)]))
    more = max(0, wide - 8)  # digits beyond the format
    if kind == "card":
        body = canon[0] + "".join(str(d.below(10)) for _ in range(len(canon) - 2 + more))
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "iban":
        body = canon[:2] + "00" + d.like(canon[4:] + "0" * min(more, 34 - len(canon)))
        return canon[:2] + f"{98 - mod97(body):02d}" + body[4:]
    if kind in ("phone", "ssn"):
        country = re.match(r"\+\d{1,3}", canon).group()[: len(canon) - 8] if canon.startswith("+") and len(canon) > 9 else ""
        rest = canon[len(country) :]
        plus = "+" if not country and rest.startswith("+") else ""
        digits = len(rest) - len(plus) + more
        return country + plus + str(1 + d.below(9) if not country or len(rest) > 7 else d.below(10)) + "".join(str(d.below(10)) for _ in range(digits - 1))
    where = script(canon)
    if kind == "surname":
        heads, tails = SURNAME[where]
        return (heads[d.below(len(heads))] + "".join(tails[d.below(len(tails))] for _ in range(1 + (attempt > 1) + wide))).casefold()
    gender = kind.partition(":")[2]
    pool = GIVEN[where, gender] if gender in "fm" else GIVEN[where, "f"] + GIVEN[where, "m"]
    return "-".join(pool[d.below(len(pool))] for _ in range(1 + (attempt > 3) + wide)).casefold()


def render(mention: str, kind: str, new: str) -> str:
    """A surrogate's canonical form in the mention's format: separators, padding and case."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(new)
        return "".join(next(rest, "") if c.isalnum() or c == "+" else c for c in mention) + "".join(rest)
    if kind == "email":
        return new.upper() if mention.isupper() else "".join(b.upper() if a.isupper() else b for a, b in zip(mention, new)) + new[len(mention) :] if len(new) == len(mention) else new
    if kind in ("ip", "ipv6"):
        return new.upper() if re.search("[A-F]", mention) else new
    return new.upper() if mention.isupper() and len(mention) > 1 else re.sub(r"[^\W\d_]+", lambda m: m.group().capitalize(), new)


def _split(column: int, told_as: list[str] | None = None):
    """For mapInArrow: the rows without an entity, or those with one, beside the text's MD5 and its different entities, told as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                texts = batch.column(column).to_pylist()
                found = [dict.fromkeys(x[2:] for x in entities(t)) for t in texts]
                if told_as is None:
                    yield batch.filter(pa.array([not x for x in found], pa.bool_()))
                    continue
                some = batch.filter(pa.array([bool(x) for x in found], pa.bool_()))
                md5 = [hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t, x in zip(texts, found) if x]
                kinds = pa.struct([("kind", pa.string()), ("canon", pa.string())])
                told = pa.array([[{"kind": k, "canon": c} for k, c in x] for x in found if x], pa.list_(kinds))
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(some.num_columns)), pa.array(md5, pa.string()), told], names=[*some.schema.names, *told_as])

    return run


def _draw(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(*x, key) for x in zip(*(b.column(k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(new, pa.string())], names=["kind", "canon", "attempt", "new"])

    return run


def _broad(kind: str):
    """Kinds that could be mistaken for each other when printed share a name space."""
    return F.when(F.col(kind).startswith("given"), F.lit("given")).otherwise(F.col(kind))


def assign(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, new): a surrogate for each distinct entity; no two entities share one, and none is itself an entity of the corpus.

    Every round draws for the entities still open and keeps the draws that collide with nothing: of those that agree
    with each other the least entity's; none that agrees with an entity seen or a surrogate kept. Formats widen with the rounds,
    so it ends however many entities there are.
    """
    real = found.select("kind", "canon").distinct().withColumn("space", _broad("kind"))
    names = real.where("space = 'given'").select(F.lit("given").alias("space"), "canon")
    # given names come from lists that hold real names, so only their distinctness can be asked for
    taken = real.select("space", "canon").exceptAll(names).withColumnRenamed("canon", "new")
    open_ = real.select("kind", "canon", F.lit(0).alias("attempt"))
    done = None
    while True:
        drawn = cut(open_.mapInArrow(_draw(key), "kind string, canon string, attempt int, new string").withColumn("space", _broad("kind")), "drawn")
        first = F.row_number().over(Window.partitionBy("space", "new").orderBy("canon", "kind")) == 1
        fresh = drawn.withColumn("first", first).join(taken, ["space", "new"], "left_anti").where("first")
        if done is not None:
            fresh = fresh.join(done.select("space", "new"), ["space", "new"], "left_anti")
        kept = cut(fresh.select("kind", "canon", "new", "space"), "surrogates")
        done = kept if done is None else done.union(kept)
        open_ = drawn.join(kept, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return done.select("kind", "canon", "new")


def _rewrite(column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, column)):
            texts = []
            for text, known in zip(b.column(column).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if known:
                    known, parts, at = {(x["kind"], x["canon"]): x["new"] for x in known}, [], 0
                    for begin, end, kind, canon in entities(text):
                        parts += [text[at:begin], render(text[begin:end], kind, known[kind, canon])]
                        at = end
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            out = [b.column(k) for k in range(b.num_columns - 1)]
            out[column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(out, names=b.schema.names[:-1])

    return run


def key_of(spark: SparkSession) -> str:
    """The session's key, or else one of this run's own."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs with every detected entity replaced in text; the other columns stay as they are, whatever their names.

    E-mail addresses, IP addresses, card numbers, IBANs, social security and telephone numbers, and personal names (after a
    title or an introduction, or a listed given name with the surname after it) are entities; digits may be of any script.
    Mentions that differ only in case or separators are one entity and get one surrogate, everywhere and in every run with
    the key; different entities get different ones; of overlapping ones the first holds. Null and empty texts stay; very
    long ones are read whole; rows of null ids and repeated rows are rewritten like others; empty tables stay empty.

    Rows without entities pass through; only the others are written, exchanged and joined to their surrogates.
    """
    if not key:
        raise ValueError("surrogates need a key")
    names, at = docs.columns, docs.columns.index("text")
    md5, entity, known = unused(docs, "md5", "found", "known")
    plain = docs.withColumn("text", F.col("text").cast("string"))
    wider = StructType([*plain.schema.fields, *StructType.fromDDL(f"{md5} string, {entity} array<struct<kind: string, canon: string>>").fields])
    hits = cut(plain.mapInArrow(_split(at, [md5, entity]), wider), "hits")
    found = cut(hits.select(F.col(md5).alias("text_md5"), F.explode(entity).alias("e")).select("text_md5", "e.kind", "e.canon").distinct(), "entities")
    told = found.join(assign(found, key), ["kind", "canon"]).groupBy(F.col("text_md5").alias(md5)).agg(F.collect_list(F.struct("kind", "canon", "new")).alias(known))
    rewritten = hits.join(told, md5, "left").select(*names, known).mapInArrow(_rewrite(at), plain.schema)
    return plain.mapInArrow(_split(at), plain.schema).unionByName(rewritten)
