"""Personal information in free text: found, and replaced by typed placeholders.

One pass over the texts finds what could be an item by its form alone (addresses of mail, groups of digits, pairs of words, streets with numbers) and
counts the words of all texts. Forms only propose. What a candidate discloses is then estimated from the whole collection: an entity of a kind
that is beyond doubt (a given name of the list beside a word, a number of an unmistakable form, ...) has the information IC = -log2 of its share of
all words, and a term that has it beside it in a share of the term's own occurrences tells PMI bits of it. A term discloses the kind if it tells all
but a small part of IC, so the threshold in bits follows from the collection and is always positive. Terms are family names by given names, further given names by family names,
hosts of mail, streets, the words that announce numbers, and the ways that announced numbers are written. Candidates made of disclosing terms are items.
Shares are smoothed, so a term that occurs once counts, but less than one seen often.

The work is done on the plain form; offsets are those of the stored value.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.plainform import NO_SCORES, ScriptScores, plain_with_offsets
from ledgerloom.operators.scratch import Scratch

#: What a disclosing term may leave of an entity's information, as (share of it, bits that are always allowed): words of an item itself, against all words;
#: family names that are beside a given name which is known, or as long as only the list's given names are known; words that only announce
#: a number, against all announced numbers.
OWN_REST, FIRST_REST, NEAR_REST = (0.1, 1.0), (0.35, 2.0), (0.85, 0.0)
_HELD = 1 << 18  # words whose counts a task holds before it sends them


def _letters(test) -> str:
    """A character class of the letters of the scripts that have capitals, by the Unicode data."""
    parts: list[list[int]] = []
    for cp in [*range(0x41, 0x590), *range(0x10A0, 0x1100), *range(0x1E00, 0x2000), *range(0x2C60, 0x2C80), *range(0xA640, 0xA7FF)]:
        if test(chr(cp)):
            if parts and parts[-1][1] == cp - 1:
                parts[-1][1] = cp
            else:
                parts.append([cp, cp])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in parts)


_L = _letters(str.isalpha)
_UP = _letters(lambda c: c.isupper() or c.istitle())
_LOW = _letters(str.islower)
_DOT = r"(?:\s{0,3}[\[({]\s?dot\s?[\])}]\s{0,3}|\s{1,3}dot\s{1,3})"
_AT = r"(?:@|\s{0,3}[\[({]\s?at\s?[\])}]\s{0,3}|\s{1,3}at\s{1,3})"
_LOCAL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9_][A-Za-z0-9._%+\-]*"
#: Written with signs, or with the words at and dot.
_EMAIL = re.compile(rf"{_LOCAL}(?:@(?P<host>[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{{2,}})|{_AT}(?P<said>[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}))(?![A-Za-z0-9])", re.I)
_SAID_DOT = re.compile(_DOT, re.I)
_NUMBER = re.compile(r"(?<![A-Za-z0-9_\-./:+])(?:[A-Za-z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-Za-z](?![A-Za-z0-9])|\+?\(?\d+(?:\)?[\s.\-/]{1,3}\(?\d+|\)\d+|/\d+)+(?:[\s\-]{0,2}[A-Za-z](?![A-Za-z0-9]))?|\d{6,})(?![A-Za-z0-9_])")
# Words that stand between a given and a family name.
_PARTICLES = "de|da|di|del|della|der|den|van|von|la|le|bin|al|el|dos|du|ter|zu"
_BETWEEN = rf"\s{{1,3}}(?:[{_UP}]\.\s{{0,3}})?(?:(?:{_PARTICLES})\s{{1,3}}){{0,3}}"
_GIVEN_FAMILY = re.compile(rf"(?<![{_L}\-])(?=([{_UP}][{_L}'’]+(?:-[{_UP}][{_L}]+)?){_BETWEEN}([{_UP}][{_L}'’]+(?:-[{_UP}][{_L}]+)?))")
_GIVEN_FAMILY_FLAT = re.compile(rf"(?<![{_L}\-])(?=([{_L}][{_L}'’]+(?:-[{_L}]+)?)\s{{1,3}}(?:[{_L}]\.\s{{0,3}})?([{_L}][{_L}'’]+(?:-[{_L}]+)?))")
_LOWER = re.compile(f"[{_LOW}]")
_UPPER = re.compile(f"[{_UP}]")
# Words that make a street or a post box, by language.
_WAYS_EN = "Road|Rd|Lane|Ln|Avenue|Ave|Street|St|Drive|Close|Court|Terrace|Boulevard|Blvd|Square|Way"
_WAYS_DE = "straße|strasse|str\\.|weg|gasse|platz|allee|ring|damm|ufer"
_WAYS_ES = "Calle|C/|Avenida|Avda\\.|Av\\.|Plaza|Paseo|Camino|Ronda"
_WAYS_FR = "rue|avenue|impasse|boulevard|place|chemin|allée|quai|cours"
_BOXES = "P\\.?\\s?O\\.?\\s?Box|PO Box|Postfach|Apartado(?: de correos)?|B\\.?P\\.?|а/я"
_STEM = rf"[{_L}][{_L}'’]+(?:-[{_L}]+)?"
_STEMS = rf"{_STEM}(?:\s{_STEM}){{0,3}}"
#: An item of this kind has a number; the text behind the number, or before it, makes it an address.
_HOUSE = re.compile(r"(?<![\w.\-/])\d+")
_BEHIND = [
    re.compile(rf"\d+[A-Za-z]?\s{{1,3}}((?:{_STEM}\s{{1,3}}){{0,3}}?{_STEM})\s{{1,3}}(?:{_WAYS_EN})(?![{_L}])\.?", re.I),
    re.compile(rf"\d+(?:\s(?:bis|ter))?,?\s{{1,3}}(?:{_WAYS_FR})\s{{1,3}}(?:(?:de|du|des)\s{{1,3}}(?:la\s{{1,3}})?)?({_STEM})", re.I),
]
_FLAT = re.compile(r"(?:Flat|Unit|Apt|Suite)\.?\s{1,3}\d+[A-Za-z]?,?\s{1,3}$", re.I)
#: (what the text before must hold, pattern up to the number, pattern from the number, pattern from the number where it is beyond doubt)
_BEFORE = [
    (tuple("straße strasse str. weg gasse platz allee ring damm ufer".split()), re.compile(rf"(?<![{_L}\-])((?:{_STEM})?(?:{_WAYS_DE})|{_STEM}\s{{1,3}}(?:{_WAYS_DE}))\s{{1,3}}$", re.I), re.compile(r"\d+\s?(?:[a-z](?!\w))?", re.I), None),
    (("am ", "an der", "im ", "zum ", "zur "), re.compile(rf"(?<![{_L}\-])(?:Am|An der|Im|Zum|Zur)\s{{1,3}}({_STEM})\s{{1,3}}$", re.I), re.compile(r"\d+\s?(?:[a-z](?!\w))?", re.I), re.compile(r"\d+\s?[a-z]?,\s{1,3}\d{5}(?!\d)", re.I)),
    (("calle", "c/", "av", "plaza", "paseo", "camino", "ronda"), re.compile(rf"(?<![{_L}\-])(?:{_WAYS_ES})\s{{0,3}}(?:de\s{{1,3}}(?:la\s{{1,3}})?)?({_STEMS})\s?,?\s{{1,3}}$", re.I), re.compile(r"\d+"), None),
    (("ул", "пр", "пер."), re.compile(r"(?<!\w)(?:ул\.|улица|пр\.|проспект|пер\.)\s{1,3}([А-ЯЁа-яё\-]+),?\s{1,3}(?:д\.\s?)?$", re.I), re.compile(r"\d+"), None),
    (("box", "postfach", "apartado", "p.", "bp", "а/я"), re.compile(rf"(?<![{_L}])(?:{_BOXES})\s{{0,3}}()$", re.I), re.compile(r"\d+"), None),
]
_COMMA = re.compile(rf"[,;]\s{{1,3}}([{_L}][{_L}'’]+)")
_FAMILY = re.compile(rf"(?<![{_L}\-])([{_L}][{_L}'’]+(?:-[{_L}]+)?)\s?$")
# Forms of numbers that are unmistakable, digits as 0 and letters as A.
SURE_FORMS = {"phone": [r"\+.*", r"\(000\) 000-0000"], "id_number": ["AA ?00 ?00 ?00 ?A", "000-00-0000", r"00\.000\.000-A", "0 00 00 00 000 000 00"]}
_WORDS = re.compile(r"[^\W\d_]+")
_COUNTED = re.compile(rf"[{_L}][{_L}'’]+")
_CJK = re.compile("[぀-ヿ㐀-鿿]")


def number_form(text: str) -> str:
    """How a number is written: digits as 0, letters as A, white space as one space."""
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "0", re.sub(r"\s+", " ", text)))


def _words_before(text: str, at: int, count: int) -> list[tuple[int, str]]:
    """(offset, word) of the last words before a place, up to `count`, however long they are."""
    size = 32
    while True:
        start = max(0, at - size)
        found = [(m.start(), m.group()) for m in _WORDS.finditer(text, start, at)]
        # the first word may be cut
        if not start or len(found) > count:
            return found[-count:]
        size *= 4


def _announced(text: str, at: int) -> tuple[str, str]:
    """The last word before a place, and the last two."""
    words = [w.lower() for _, w in _words_before(text, at, 2)]
    if not words:
        return "", ""
    last = words[-1][-3:] if _CJK.search(words[-1]) else words[-1]
    return last, f"{words[-2]} {last}" if len(words) > 1 else last


def _addresses_at(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, street, surely) of what is written like an address around a number."""
    lower = text.lower()
    before_hints = [x for x in _BEFORE if any(h in lower for h in x[0])]
    for m in _HOUSE.finditer(text):
        at = m.start()
        for pattern in _BEHIND:
            if found := pattern.match(text, at):
                flat = _FLAT.search(text, max(0, at - 16), at)
                street = found[1].split()
                # capitals tell streets of several words only where the words before have none
                before = _words_before(text, at, 1) if len(street) > 1 else []
                yield flat.start() if flat else at, found.end(), found[1], all(w[0].isupper() for w in street) and not (before and before[0][1][0].isupper())
        if not before_hints:
            continue
        words = _words_before(text, at, 7)
        start = words[0][0] if words else at
        window = text[start:at]
        low = lower[start:at]
        for hints, before, behind, doubtless in before_hints:
            if any(h in low for h in hints) and (head := before.search(window)) and (tail := (doubtless and doubtless.match(text, at)) or behind.match(text, at)):
                sure = not head[1] or head[1][0].isupper() and " " not in head[1] and (not doubtless or tail.re is doubtless)
                yield start + head.start(), tail.end(), head[1], sure


def candidates(text: str) -> Iterator[tuple[str, int, int, str, str, bool]]:
    """(kind, start, end, term, other term, surely) of what could be an item in a plain text."""
    if "@" in text or "dot" in text or "DOT" in text or "Dot" in text:
        for m in _EMAIL.finditer(text):
            said = m["said"]
            dots = _SAID_DOT.findall(said) if said else []
            yield "email", m.start(), m.end(), (m["host"] or _SAID_DOT.sub(".", said)).lower(), "", not said or all(d.strip()[0] in "[({" for d in dots)
    for m in _NUMBER.finditer(text):
        if sum(map(str.isdigit, m.group())) >= 6:
            yield ("number", m.start(), m.end(), number_form(m.group()), "\n".join(_announced(text, m.start())), True)
    for start, end, street, sure in _addresses_at(text):
        yield "address", start, end, " ".join(street.lower().split()), "", sure
    flat = not _UPPER.search(text) or not _LOWER.search(text)
    for m in (_GIVEN_FAMILY_FLAT if flat else _GIVEN_FAMILY).finditer(text):
        yield "flat name" if flat else "name", m.start(1), m.end(2), m[1].lower(), m[2].lower().split("-")[0], True
    if "," in text or ";" in text:
        for m in _COMMA.finditer(text):
            if flat or m[1][0].isupper():
                words = _words_before(text, m.start(), 2)
                family = words and _FAMILY.search(text, words[0][0], m.start())
                if family and (flat or family[1][0].isupper()):
                    yield "name", family.start(1), m.end(), m[1].lower(), family[1].lower().split("-")[0], False


def scan(rows: DataFrame, fields: tuple[str, ...], scores: ScriptScores = NO_SCORES) -> DataFrame:
    """(id, field, kind, start_at, end_at, term, other, sure) of candidates() in stored offsets; start_at is at a letter or digit. Rows of
    kind `word` have, as start_at, how often a task saw the word `term`; addresses of mail have no words."""
    names = ["id", "field", "kind", "start_at", "end_at", "term", "other", "sure"]
    types = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()] * 2 + [pa.bool_()]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 8, types)], names=names)

    def counted(words: Counter) -> pa.RecordBatch:
        out = batch_of([(None, None, "word", n, None, w, None, None) for w, n in words.items()])
        words.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for k, field in enumerate(fields):
                for record, value in zip(ids, batch.column(k + 1).to_pylist()):
                    if not value:
                        continue
                    text, offsets = plain_with_offsets(value, scores)
                    mails, at = [], 0
                    for kind, start, end, term, other, sure in candidates(text):
                        if kind == "email":
                            mails.append(text[at:start])
                            at = end
                        while start < end - 1 and not text[start].isalnum():
                            start += 1
                        out.append((record, field, kind, offsets[start] if offsets else start, (offsets[end - 1] if offsets else end - 1) + 1, term, other, sure))
                    words.update(_COUNTED.findall((" ".join([*mails, text[at:]]) if mails else text).lower()))
            yield batch_of(out)
            if len(words) > _HELD:
                yield counted(words)
        yield counted(words)

    own = rows.where(F.col("id").isNotNull()).select("id", *fields)
    return own.mapInArrow(run, "id string, field string, kind string, start_at int, end_at int, term string, other string, sure boolean")


def disclosing_terms(counts: DataFrame, term: str, places: DataFrame | None, rest: tuple[float, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(term) that disclose an entity. counts: rows of a term with `n`, how often it occurs, and `hits`, how often with the entity; both are summed by term.

    With N = the number of places where the entity could be (`places`, one row; where it isn't given, all occurrences of terms), IC = -log2(all hits / N) is what the entity's presence tells, and PMI = log2(share * N / all hits) what the term tells of it, share
    being (hits + 1/2) / (n + 1). The term discloses if PMI >= IC - max(rest[0] * IC, rest[1]), and PMI > 0. `keys`: columns that set entities apart, each with a test of its own."""
    by = counts.groupBy(*keys, term).agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).where("hits > 0")
    totals = counts.groupBy(*keys).agg(F.sum("hits").alias("all_hits"), F.sum("n").alias("places")).where("all_hits > 0")
    if places is not None:
        totals = totals.drop("places").crossJoin(places.toDF("places"))
    both = by.join(F.broadcast(totals), list(keys)) if keys else by.crossJoin(F.broadcast(totals))  # one row for each entity kind
    chance = F.col("all_hits") / F.greatest("places", F.col("all_hits") + 1)
    share = F.least((F.col("hits") + 0.5) / (F.greatest("n", "hits") + 1), F.lit(1.0))
    left = F.greatest(-rest[0] * F.log2(chance), F.lit(rest[1]))
    return both.where((-F.log2(share) <= left) & (share > chance)).select(*keys, term)


def _names(found: DataFrame, given_names: DataFrame, words: DataFrame, all_words: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of which one word discloses a given name beside it, and the other one a family name."""
    seeds = given_names.select(F.lower(F.trim("given_name")).alias("term")).where("term <> ''").distinct()
    names = found.where("kind IN ('name', 'flat name')")
    pairs = scratch.save(names.groupBy("term", "other").agg(F.count_if(F.expr("sure and kind = 'name'")).alias("direct"), F.count_if(F.expr("not sure or kind <> 'name'")).alias("apart")))

    def learned(term: str, beside: str, known: DataFrame, rest: tuple[float, float] = OWN_REST) -> DataFrame:
        """Only pairs of capitals in direct order speak for a term, as words like `signed` come before a comma and a name, too."""
        hits = pairs.join(known.withColumnRenamed(known.columns[0], beside), beside, "left_semi").groupBy(term).agg(F.sum("direct").alias("hits"), F.sum("apart").alias("apart"))
        return disclosing_terms(hits.join(words.withColumnRenamed("word", term), term, "left").withColumn("n", F.coalesce(F.col("n") - F.col("apart"), "hits")), term, all_words, rest)

    families = learned("other", "term", seeds, FIRST_REST)
    givens = scratch.save(learned("term", "other", families).unionByName(seeds).distinct())
    named = names.join(givens, "term", "left_semi")
    told = named.join(learned("other", "term", givens), "other", "left_semi")
    # capitals and the usual order speak for a name, too
    near = named.where("sure and kind = 'name'").join(learned("other", "term", givens, FIRST_REST), "other", "left_semi")
    return told.unionByName(near).select("id", "field", F.lit("name").alias("kind"), "start_at", "end_at").distinct()


def _numbers(found: DataFrame, all_words: DataFrame, scratch: Scratch) -> DataFrame:
    """Numbers of forms that disclose a kind: forms that are unmistakable, and those that are mostly announced by words which disclose the kind."""
    numbers = found.where("kind = 'number'").select("id", "field", "start_at", "end_at", F.col("term").alias("form"), F.split("other", "\n").alias("terms"))
    sure = F.lit(None).cast("string")
    for kind, forms in SURE_FORMS.items():
        sure = F.when(F.col("form").rlike("^(?:" + "|".join(forms) + ")$"), kind).otherwise(sure)
    uses = scratch.save(numbers.groupBy("form", sure.alias("sure"), "terms").agg(F.count("*").alias("n")))
    kinds = F.explode(F.array(*map(F.lit, SURE_FORMS))).alias("to")
    hit = F.when(F.col("sure") == F.col("to"), F.col("n")).otherwise(0).alias("hits")
    near = uses.select("sure", "n", F.explode("terms").alias("announcer"), kinds).where("announcer <> ''").select("announcer", "to", "n", hit)
    announcers = disclosing_terms(near, "announcer", None, NEAR_REST, ("to",))
    told = uses.select("form", "terms", F.explode("terms").alias("announcer")).join(announcers, "announcer").select("form", "terms", "to").distinct().withColumn("told", F.lit(True))
    marked = uses.where("sure is null").select("form", "terms", "n", kinds).join(told, ["form", "terms", "to"], "left")
    learned = disclosing_terms(marked.select("form", "to", "n", F.when(F.col("told"), F.col("n")).otherwise(0).alias("hits")), "form", all_words, OWN_REST, ("to",))
    # a form that is sure for one kind is no other
    forms = uses.where("sure is not null").select("form", F.col("sure").alias("kind")).unionByName(learned.select("form", F.col("to").alias("kind"))).groupBy("form").agg(F.min("kind").alias("kind"))
    return numbers.join(forms, "form").select("id", "field", "kind", "start_at", "end_at")


def _by_host_or_street(found: DataFrame, all_words: DataFrame) -> DataFrame:
    """Addresses of mail and of streets: those beyond doubt, and those whose host or street discloses one, as it is mostly seen in such that are beyond doubt."""
    own = found.where("kind IN ('email', 'address')")
    counts = own.where("term <> ''").select("kind", "term", F.lit(1).alias("n"), F.col("sure").cast("int").alias("hits"))
    told = disclosing_terms(counts, "term", all_words, OWN_REST, ("kind",))
    place = ("id", "field", "kind", "start_at", "end_at")
    return own.where("sure").select(*place).unionByName(own.where("not sure").join(told, ["kind", "term"], "left_semi").select(*place))


def personal_items(rows: DataFrame, given_names: DataFrame, scratch: Scratch, fields: tuple[str, ...] = ("captured_text", "excerpt"), scores: ScriptScores = NO_SCORES) -> DataFrame:
    """(id, field, kind, start_at, end_at) of each item; see p6_found in TESTDATA.md.

    given_names: some given names, which start the learning of names; none of them, none is found. Null and empty values have no items, rows
    without an id are left out; repeated deliveries are one record. Items may not overlap: of two of one start the
    longer stays. Other columns are not read.
    """
    found = scratch.save(scan(rows, fields, scores))
    words = scratch.save(found.where("kind = 'word'").groupBy(F.col("term").alias("word")).agg(F.sum("start_at").alias("n")))
    all_words = scratch.save(words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words")))
    items = _by_host_or_street(found, all_words).unionByName(_names(found, given_names, words, all_words, scratch)).unionByName(_numbers(found, all_words, scratch))
    return items.groupBy("id", "field", "start_at").agg(F.max(F.struct("end_at", "kind")).alias("x")).select("id", "field", "x.kind", "start_at", "x.end_at")


def redacted(rows: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("captured_text", "excerpt")) -> DataFrame:
    """(id, and each field with its items replaced by [NAME], [EMAIL], [PHONE], [ID_NUMBER] or [ADDRESS]), one row per record.

    Values without items come out as they are, nulls as nulls."""
    lists = items.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start_at", "end_at", "field", "kind"))).alias("items"))  # the items of one record
    own = rows.where(F.col("id").isNotNull()).select("id", *fields).dropDuplicates(["id"]).join(lists, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(fields) + 1).to_pylist()
            out = [batch.column(0)]
            for k, field in enumerate(fields):
                values = [replace(v, [s for s in own or () if s["field"] == field]) for v, own in zip(batch.column(k + 1).to_pylist(), spans)]
                out.append(pa.array(values, pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["id", *fields])

    return own.select("id", *fields, "items").mapInArrow(run, "id string, " + ", ".join(f"{f} string" for f in fields))


def replace(value: str | None, spans: list[dict]) -> str | None:
    """A value with its spans, sorted by start, replaced by placeholders; a span inside one before it is left out."""
    if value is None or not spans:
        return value
    out, at = [], 0
    for s in spans:
        if s["start_at"] >= at:
            out += [value[at : s["start_at"]], f"[{s['kind'].upper()}]"]
            at = s["end_at"]
    return "".join([*out, value[at:]])
