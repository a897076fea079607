"""Personal data replaced by keyed, type-consistent surrogates.

Entities are found by patterns and brought to a canonical form, so that all
ways of writing one entity meet.  Names are found behind a title; within the
same text their full and family names are found without it too.  Each distinct entity of the corpus gets one
surrogate by a keyed hash: digits for digits, letters of the same script and
case, names of the same gender.  A collision check over all entities keeps
surrogates distinct from one another and from everything that was found; what
collides draws again from a wider range, and what is still open at the end gets
values by number that nobody has.  Each mention is then rewritten in its own
format.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.components import checkpointed

#: Set a secret of your own: whoever knows it can test guesses of the replaced values.
DEFAULT_KEY = "change-me"

# Titles that tell a name and its gender.
FEMALE_TITLES = "Mrs Ms Miss Madame Mme Mademoiselle Mlle Frau Señora Sra Señorita Srta Doña Госпожа"
MALE_TITLES = "Mr Monsieur Herr Señor Sr Господин"
# Syllables of surrogate names by script; endings by script and gender.
SYLLABLES = {
    "latin": "al an ar be bel bra cal cor da del do el en fa fer ga gil han is jo ka kel la len li lo ma mar mi mon na nel no ol pa per ra ren ri ro sa sel si sol ta tel ti tor va vel vi wen za".split(),
    "cyrillic": "ал ан бо вал вер га гор да дан ев же за зор ир ка кол ла лен ли ма мир на ник ол па рад ра ро са свет та тим ул фед ха цар ша юр яр".split(),
}
ENDINGS = {("latin", "f"): "a ia ina elle ette".split(), ("latin", "m"): "o us an ert in".split(), ("cyrillic", "f"): "а ия ина".split(), ("cyrillic", "m"): "ий ан ор".split()}

_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_NAME = rf"[{_UPPER}][\w'’-]*[^\W\d_]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = "|".join((FEMALE_TITLES + " " + MALE_TITLES).split())
#: Patterns by kind, in order of precedence; the group "v" is what is replaced.
PATTERNS = {
    "secret": r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[=:]\s*[\"']?)(?P<v>[A-Za-z0-9_+/=.~-]{8,})"
    r"|\b(?P<v2>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})\b",
    "email": r"(?<![A-Za-z0-9._%+-])(?P<v>[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)",
    "ipv4": rf"(?<![\w.])(?P<v>{_OCTET}(?:\.{_OCTET}){{3}})(?!\.?\w)",
    "iban": r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "phone": r"(?<![\w+])(?P<v>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "ssn": r"(?<![\w-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])",
    "card": r"(?<![\w.-])(?P<v>\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\w-])",
    "name": rf"\b(?P<t>{_TITLES})\b\.?[ \u00a0](?P<v>{_NAME}(?:[ \u00a0]{_NAME})?)",
}
#: What every text with an entity has; a cheap test that spares the others the whole search.
HINT = rf"[@+]|\d[\d .()-]*\d|(?i:token|secret|passw|pwd|key|auth)|\b(?:{_TITLES})\b|(?:AKIA|ASIA)|gh[pousr]_|sk-|xox"

_ALL = [(kind, re.compile(pattern)) for kind, pattern in PATTERNS.items()]
_WORD = re.compile(rf"(?<![\w-])(?<!\w['’]){_NAME}")
_GAP = re.compile(r"[ \u00a0]|\r?\n")
_DIGITS = {"phone", "card", "ssn"}
#: Shorter numbers behind a plus sign are counts, years and the like.
MIN_PHONE_DIGITS = 7
_SYMBOLS = "_+/=.~-"
_FIXED = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-)?")
_BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
# Syllables of equal length, so that numbers written with them differ.
_EVEN = {"latin": [c + v for c in "bdfghjklmnprstvz" for v in "aeiou"], "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"]}


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) of a text's entities, in order and without overlap."""
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern in _ALL:
        for m in pattern.finditer(text):
            group = "v2" if kind == "secret" and m.group("v2") else "v"
            a, b = m.span(group)
            value = text[a:b]
            if kind == "email":
                a += len(value) - len(value.lstrip("._%+-"))
                value = text[a:b]
                if value.startswith("@"):
                    continue
            if kind == "name":
                value = _bare(value)
                b = a + len(value)
            if kind == "card" and sum(c.isdigit() for c in value) < 13:
                continue
            if kind == "iban" and sum(c.isdigit() for c in value) < 8:
                continue
            if kind == "phone" and sum(c.isdigit() for c in value) < MIN_PHONE_DIGITS:
                continue
            # the line of a form or a mask; other values of symbols alone can be passwords
            if kind == "secret" and not any(c.isalnum() for c in value) and len(set(value)) < 3:
                continue
            taken.append((a, b, kind, _canonical(kind, value, m.group("t") if kind == "name" else "")))
    rank = {kind: i for i, kind in enumerate(PATTERNS)}
    out: list[tuple[int, int, str, str]] = []
    for item in sorted(taken, key=lambda x: (rank[x[2]], x[0])):
        at = bisect.bisect(out, item)
        if (at == 0 or out[at - 1][1] <= item[0]) and (at == len(out) or item[1] <= out[at][0]):
            out.insert(at, item)
    return _named_again(text, out) if any(item[2] == "name" for item in out) else out


def _bare(name: str) -> str:
    """A name without what a dash or a possessive adds."""
    name = name.split("--")[0]
    return re.sub(r"(?<=\w)['’][sS]$", "", name)


def _named_again(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The entities with those of one person joined, and the names of the text that stand without a title.

    A family name means the person of that full name and gender who is named
    last before it, else first behind it; without a title the gender is open.
    Without a full name it is an entity of its own.
    """
    full: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for a, _, kind, canonical in found:
        if kind == "name" and " " in canonical:
            full.setdefault((canonical[0], canonical.rpartition(" ")[2]), []).append((a, canonical))
    joined: list[tuple[int, int, str, str]] = []
    known: dict[str, list[tuple[int, str]]] = {}  # by name without title: places and entities
    for a, b, kind, canonical in found:
        if kind == "name":
            name = canonical.split(":", 2)[2]
            if " " not in name and (canonical[0], name) in full:
                canonical = _nearest(full[canonical[0], name], a)
            for form in {name, name.rpartition(" ")[2]}:
                known.setdefault(form, []).append((a, canonical))
        joined.append((a, b, kind, canonical))
    last = None
    more = []
    for m in _WORD.finditer(text):
        word = _bare(m.group())
        a, b, form = m.start(), m.start() + len(word), word.casefold()
        if form in known:
            both = f"{last[2]} {form}" if last and _GAP.fullmatch(text, last[1], a) else ""
            if both in known:
                more.append((last[0], b, "name", _nearest(known[both], last[0])))
            else:
                more.append((a, b, "name", _nearest(known[form], a)))
        last = (a, b, form)
    for item in more:
        at = bisect.bisect(joined, item)
        if (at == 0 or joined[at - 1][1] <= item[0]) and (at == len(joined) or item[1] <= joined[at][0]):
            joined.insert(at, item)
    return joined


def _nearest(places: list[tuple[int, str]], at: int) -> str:
    """The entity last named before a place, else the first behind it; places are in order."""
    return places[max(0, bisect.bisect(places, at, key=lambda x: x[0]) - 1)][1]


def _canonical(kind: str, value: str, title: str) -> str:
    """One text for all ways of writing an entity; a name starts with its gender and script."""
    if kind in _DIGITS:
        digits = "".join(c for c in value if c.isdigit())
        # the two national ways of writing are North American
        return "1" + digits if kind == "phone" and not value.startswith("+") else digits
    if kind == "email":
        return value.lower()
    if kind == "iban":
        return value.replace(" ", "").upper()
    if kind == "name":
        gender = "f" if title in FEMALE_TITLES.split() else "m"
        script = "cyrillic" if re.search("[а-яё]", value.lower()) else "latin"
        return f"{gender}:{script}:{' '.join(value.split()).casefold()}"
    return value


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: str, *parts: str):
        self.seed = hashlib.blake2b("\x1f".join(parts).encode(), key=hashlib.sha256(key.encode()).digest(), digest_size=32).digest()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left += hashlib.blake2b(self.seed + self.block.to_bytes(8, "little")).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:8], "little"), self.left[8:]
        return value % n


def _luhn(digits: str) -> int:
    """0 for a valid number, else what its sum is off."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _shaped(value: str, draw: _Stream, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha() and c.isascii():
            new = letters[draw.below(len(letters))]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _private(address: str) -> int:
    """How many leading parts of an address mark a private net."""
    parts = address.split(".")
    return 1 if parts[0] == "10" else 2 if parts[:2] == ["192", "168"] else 0


def surrogate(key: str, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of an entity's stand-in; later attempts draw from a wider range.

    From the fourth attempt on phones, emails, names and secrets get longer and
    private addresses come from 10/8; from the eighteenth on the other numbers
    get longer too and addresses come from the reserved 240/4.
    """
    draw = _Stream(key, kind, canonical, str(attempt))
    wider, much_wider = max(0, attempt - 2), max(0, attempt - 16)
    if kind in _DIGITS:
        keep = 1 if kind == "phone" or canonical[0] == "0" else 0
        valid = kind == "card" and _luhn(canonical) == 0
        canonical += "0" * (wider if kind == "phone" else much_wider)
        digits = canonical[:keep] + "".join(
            str(2 + draw.below(8)) if i == 0 else str(draw.below(10)) for i, _ in enumerate(canonical[keep:])
        )
        if kind == "card":
            digits = canonical[0] + digits[1:]
            if valid:
                digits = _checked(digits[:-1])
        return digits
    if kind == "ipv4":
        parts, private = canonical.split("."), _private(canonical)
        kept = [str(240 + draw.below(16))] if much_wider else ["10"] if wider and private else parts[:private]
        return ".".join([*kept, *(str(1 + draw.below(254)) for _ in parts[len(kept) :])])
    if kind == "iban":
        return canonical[:2] + _shaped(canonical[2:] + "0" * much_wider, draw)
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        labels = domain.split(".")
        wide = "".join("abcdefghijklmnopqrstuvwxyz"[draw.below(26)] for _ in range(wider))
        return _shaped(local, draw) + wide + "@" + ".".join([*(_shaped(x, draw) for x in labels[:-1]), labels[-1]])
    if kind == "name":
        gender, script, name = canonical.split(":", 2)
        parts = []
        for i, word in enumerate(name.split(" ")):
            size = max(1, min(3, len(word) // 3)) + wider
            core = "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(size))
            ends = ENDINGS[script, gender]
            # the given name shows the gender; a name alone is a family name and shows none in Latin script
            shows = (i == 0 and " " in name) or script == "cyrillic"
            parts.append(core + (ends[draw.below(len(ends))] if shows else SYLLABLES[script][draw.below(len(SYLLABLES[script]))]))
        return f"{gender}:{script}:{' '.join(parts)}"
    hexadecimal = re.fullmatch("[0-9a-f]+", canonical) or re.fullmatch("[0-9A-F]+", canonical)
    if hexadecimal:
        small = canonical.lower() == canonical
        text = "".join("0123456789abcdef"[draw.below(16)] for _ in canonical + "0" * wider)
        return text if small else text.upper()
    fixed = _FIXED.match(canonical).group()
    if not any(c.isalnum() for c in canonical):
        return "".join(_SYMBOLS[draw.below(len(_SYMBOLS))] for _ in canonical + "_" * wider)
    return fixed + _shaped(canonical[len(fixed) :] + ("" if fixed in ("AKIA", "ASIA") else "a" * wider), draw)


def _checked(digits: str) -> str:
    """Digits with the check digit that makes them a valid card number."""
    return digits + str((10 - _luhn(digits + "0")) % 10)


def _written(number: int, signs, size: int) -> str:
    """A number in these signs, with at least size of them."""
    out = []
    while number or len(out) < size:
        number, at = divmod(number, len(signs))
        out.append(signs[at])
    return "".join(reversed(out))


def numbered(kind: str, canonical: str, number: int) -> str:
    """A stand-in that no other number gives in this kind, whatever the entities are."""
    if kind == "card":
        body = canonical[0] + _written(number, _BASE36[:10], len(canonical) - 2)
        valid = _checked(body)
        return valid if _luhn(canonical) == 0 else body + str((int(valid[-1]) + 1) % 10)
    if kind in _DIGITS:
        return canonical[0] + _written(number, _BASE36[:10], len(canonical) - 1)
    if kind == "ipv4":
        if number >= 2**32:
            raise RuntimeError("all addresses are taken")
        value = (240 * 2**24 + number) % 2**32
        return ".".join(str(value >> shift & 255) for shift in (24, 16, 8, 0))
    if kind == "iban":
        return canonical[:2] + _written(number, _BASE36[:10], len(canonical) - 2)
    if kind == "email":
        return "u" + _written(number, _BASE36, 6) + "@mail." + canonical.rpartition(".")[2]
    if kind == "name":
        gender, script, name = canonical.split(":", 2)
        ends = ENDINGS[script, gender]
        family = _written(number, _EVEN[script], 3) + (ends[0] if script == "cyrillic" else "")
        given = [_EVEN[script][number % len(_EVEN[script])] + ends[0]] * name.count(" ")
        return f"{gender}:{script}:{' '.join([*given, family])}"
    fixed = _FIXED.match(canonical).group()
    text = _written(number, _BASE36, max(8, len(canonical) - len(fixed)))
    return fixed + (text.upper() if fixed in ("AKIA", "ASIA") else text)


def rendered(kind: str, mention: str, canonical: str) -> str:
    """A surrogate in the format of the mention that it replaces."""
    if kind in _DIGITS:
        digits = iter(canonical[1:] if kind == "phone" and not mention.startswith("+") else canonical)
        out = "".join(next(digits, "") if c.isdigit() else c for c in mention)
        return out + "".join(digits)
    if kind == "iban":
        chars = iter(canonical)
        return "".join(c if c == " " else next(chars) for c in mention) + "".join(chars)
    if kind == "name":
        words = canonical.split(":", 2)[2].split(" ")
        words = [w.upper() if mention.isupper() and len(mention) > 1 else w.capitalize() for w in words]
        gap = re.search(r"\s+", mention)
        return gap.group().join(words) if gap else words[-1]
    if kind == "email" and mention.isupper():
        return canonical.upper()
    return canonical


def _mentions(batches):
    """Distinct (text_key, kind, canonical) of the texts of a batch."""
    for batch in batches:
        found: dict[tuple[int, str, str], None] = {}
        for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text")):
            for _, _, kind, canonical in find(text.as_py()):
                found[key, kind, canonical] = None
        if found:
            a, b, c = zip(*found)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b), pa.array(c)], names=["text_key", "kind", "canonical"])


def surrogate_table(entities: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """(kind, canonical, surrogate) for distinct entities (kind, canonical).

    A drawn surrogate is refused if it is an entity itself, if it has been
    given before, or if a smaller entity draws it in the same round; who is
    refused draws again.  Who is still open after all rounds gets a free value
    by number.
    """

    def draw(attempt):
        def run(batches):
            for batch in batches:
                kinds, values = batch.column("kind").to_pylist(), batch.column("canonical").to_pylist()
                yield pa.record_batch([*batch.columns, pa.array([surrogate(key, k, v, attempt) for k, v in zip(kinds, values)], pa.string())], names=["kind", "canonical", "surrogate"])

        return run

    schema = "kind string, canonical string, surrogate string"
    real = entities.select("kind", F.col("canonical").alias("surrogate"))
    # empty by a filter: rows given by the driver's Python start further Python workers on the executors
    open_, given = entities, real.select("kind", F.lit("").alias("canonical"), "surrogate").where(F.lit(False))
    for attempt in range(rounds):
        drawn = checkpointed(open_.mapInArrow(draw(attempt), schema))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        fine = first.join(real, ["kind", "surrogate"], "left_anti").join(given, ["kind", "surrogate"], "left_anti")
        given = checkpointed(given.unionByName(fine.select("kind", "canonical", "surrogate")))
        open_ = checkpointed(drawn.select("kind", "canonical").join(given, ["kind", "canonical"], "left_anti"))
        if open_.isEmpty():
            return given
    return checkpointed(given.unionByName(_enumerated(open_, real, given)))


def _enumerated(open_: DataFrame, real: DataFrame, given: DataFrame) -> DataFrame:
    """(kind, canonical, surrogate) of the open entities, by numbers whose values are neither real nor given.

    The entity at place p of n in sorted order tries the numbers p, n + p,
    2n + p and so on, twice as many in each round, and takes the first free one;
    as these numbers are its own, only real and given values stand in the way.
    """

    def tries(first, many, n):
        def run(batches):
            for batch in batches:
                kinds, values, places = (batch.column(c).to_pylist() for c in ("kind", "canonical", "place"))
                for at in range(first, first + many):
                    drawn = [numbered(k, v, at * n + p) for k, v, p in zip(kinds, values, places)]
                    yield pa.record_batch([*batch.columns, pa.array(drawn, pa.string()), pa.array([at] * len(drawn), pa.int64())], names=["kind", "canonical", "place", "surrogate", "at"])

        return run

    spark = open_.sparkSession
    mark = F.monotonically_increasing_id()
    rows = checkpointed(open_.orderBy("kind", "canonical").select("kind", "canonical", F.shiftright(mark, 33).alias("part"), mark.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")))
    n, offsets = 0, []
    for r in sorted(rows.groupBy("part").count().collect()):
        offsets.append((r["part"], n))
        n += r["count"]
    starts = spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in zip(*offsets)], names=["part", "start"]))
    left = checkpointed(rows.join(starts, "part").select("kind", "canonical", (F.col("start") + F.col("pos")).alias("place")))
    done = given.where(F.lit(False))
    first, many = 0, 1
    while not left.isEmpty():
        drawn = left.mapInArrow(tries(first, many, n), "kind string, canonical string, place long, surrogate string, at long")
        free = drawn.join(real, ["kind", "surrogate"], "left_anti").join(given, ["kind", "surrogate"], "left_anti")
        found = free.groupBy("kind", "canonical").agg(F.min_by("surrogate", "at").alias("surrogate"))
        done = checkpointed(done.unionByName(found))
        left = checkpointed(left.join(done, ["kind", "canonical"], "left_anti"))
        first, many = first + many, many * 2
    return done


def _rewritten(batches):
    for batch in batches:
        texts, counts = [], []
        for text, table in zip(batch.column("text"), batch.column("table").to_pylist()):
            if not text.is_valid or not table:
                texts.append(text.as_py())
                counts.append(0)
                continue
            given = {(e["kind"], e["canonical"]): e["surrogate"] for e in table}
            source, out, at, n = text.as_py(), [], 0, 0
            for a, b, kind, canonical in find(source):
                out += [source[at:a], rendered(kind, source[a:b], given[kind, canonical])]
                at, n = b, n + 1
            texts.append("".join([*out, source[at:]]))
            counts.append(n)
        yield pa.record_batch([batch.column("doc"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc", "text", "n_replaced"])


def replaced(docs: DataFrame, key: str = DEFAULT_KEY, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: struct doc of the carried columns (all by default), text with surrogates, n_replaced.

    Equal entities get equal surrogates in all documents, different ones
    different surrogates, and reruns with the same key agree.  Null and empty
    texts stay as they are.  Repeated rows are rewritten alike.  Texts without
    any trace of an entity take no part in joins; the others meet their
    surrogates by a hash of the text, which is safe if hashes are equal, since
    surrogates hold for the whole corpus.
    """
    text = F.col(text_column).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("doc"), text.alias("text"))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    suspects = rows.where(hinted).withColumn("text_key", F.xxhash64("text"))
    slim = docs.select(text.alias("text")).where(hinted).select("text", F.xxhash64("text").alias("text_key"))
    mentions = checkpointed(slim.mapInArrow(_mentions, "text_key long, kind string, canonical string").distinct())
    table = surrogate_table(checkpointed(mentions.select("kind", "canonical").distinct()), key)
    by_text = mentions.join(table, ["kind", "canonical"]).groupBy("text_key").agg(F.collect_list(F.struct("kind", "canonical", "surrogate")).alias("table"))
    kind = rows.schema["doc"].dataType.simpleString()
    done = suspects.join(by_text, "text_key", "left").select("doc", "text", "table").mapInArrow(_rewritten, f"doc {kind}, text string, n_replaced long")
    return done.unionByName(rows.where(~hinted).select("doc", "text", F.lit(0).cast("long").alias("n_replaced")))
