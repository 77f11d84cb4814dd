"""One consistent form for text that looks the same but differs in its characters.

Order: ignorable characters go, compatibility forms take their ordinary width and shape and marks are composed,
every space becomes U+0020; then each word that mixes scripts becomes a lattice of its characters' look-alikes and
Viterbi picks the best path under character bigrams counted from the whole collection.

Words of Latin, Greek and Cyrillic letters have one script each; their bigrams come from words of one script. Katakana
and kanji stand side by side in ordinary text, so there the scores also hold how often one script follows another, and
a kanji that looks like a katakana letter is one only where it fits its neighbours better so.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import spread

# Cyrillic and Greek letters beside the Latin letters they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХЗаеѕіјорсухһԁԛԝѵ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYX3aesijopcyxhdqwv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXaivopuxcj"
# Kanji beside the katakana letters they look like.
KANJI = "一二力口工夕卜八丿厶"
KANJI_KATAKANA = "ーニカロエタトハノム"
#: Letters of the model: Latin (with its extensions), Greek and Cyrillic; katakana; kanji that look like katakana.
WESTERN = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x370, 0x3FF), (0x400, 0x52F))
RANGES = (*WESTERN, (0x30A1, 0x30FA), (0x30FC, 0x30FC), *((ord(c), ord(c)) for c in KANJI))
#: Stands for every other kanji.
OTHER_KANJI = "漢"
_LETTERS = "".join(f"{chr(a)}-{chr(b)}" for a, b in WESTERN)
_KATAKANA = "ァ-ヺー"
_WORD = re.compile(f"[{_LETTERS}]+")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
#: Deleted: format characters (soft hyphen, zero-width, direction marks, byte order mark), fillers and variation selectors.
IGNORABLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
_SPACE = re.compile("[\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
#: Forms that NFKC would turn into other content than width or shape: superscripts, fractions, enclosed and squared
#: signs, dots, and spacing accents keep their characters.
_KEPT = {"<super>", "<sub>", "<fraction>", "<circle>", "<square>"}
#: What a text must hold, else it is in the consistent form already (Java regular expression).
_BESIDE = f"[{_KATAKANA}][{KANJI}]|[{KANJI}][{_KATAKANA}]|[一-鿿][{KANJI_KATAKANA}][一-鿿]"
SUSPECT = "[^\\x0a\\x0d\\x20-\\x7e\\u3041-\\u3096\\u30a1-\\u30fe\\u4e00-\\u9fff\\u3001\\u3002\\u3005\\u300c-\\u300f\\u00c0-\\u00ff\\u2018-\\u201f\\u2013\\u2014]|" + _BESIDE
_SUSPECT = re.compile("[^\n\r -~ぁ-ゖァ-ヾ一-鿿、。々「-』À-ÿ‘-‟–—]|" + _BESIDE)
#: Runs that can be a word of katakana with kanji in it, or one katakana letter inside a word of kanji.
_JAPANESE = re.compile(f"[{_KATAKANA}{KANJI}]+")
_KANJI = re.compile(f"[{KANJI}]")


def _shape_table() -> dict[int, str]:
    """Width and shape: every character whose compatibility form differs, except the kept ones."""
    table = {}
    for o in range(0x80, 0x30000):
        c = chr(o)
        tag = unicodedata.decomposition(c)
        if not tag or 0xAC00 <= o <= 0xD7A3:
            continue
        kind = tag.split()[0]
        form = unicodedata.normalize("NFKC", c)
        if form == c or kind in _KEPT or (kind == "<compat>" and (form[0] in " ." or o in (0x2025, 0x2026))):
            continue
        table[o] = form
    return table


_TABLE: dict[int, str] = {}
_HALF = re.compile("[｡-ﾟ]+")


def plain(text: str) -> str:
    """Steps without a model: ignorables, width and shape, composed marks, spaces."""
    if not _TABLE:
        _TABLE.update(_shape_table())
    text = IGNORABLE.sub("", text)
    text = _SPACE.sub(" ", _HALF.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text))
    return unicodedata.normalize("NFC", text.translate(_TABLE))


def script(c: str) -> int:
    """Latin 0, Greek 1, Cyrillic 2, katakana 3, kanji 4, anything else (an edge of words) -1."""
    if "Ͱ" <= c <= "Ͽ":
        return 1
    if "Ѐ" <= c <= "ԯ":
        return 2
    if "ァ" <= c <= "ヺ" or c == "ー":
        return 3
    if "一" <= c <= "鿿":
        return 4
    return 0 if _WORD.fullmatch(c) else -1


class Model:
    """Character bigrams and look-alikes; `bigrams` maps a pair of letters (\\n is a word's edge, OTHER_KANJI any kanji
    that looks like nothing else) to its count."""

    #: Log odds that a written letter is a look-alike, before its neighbours are known.
    CHANGED, CHANGED_JAPANESE = -0.5, -3.0

    def __init__(self, bigrams: dict[str, int], aliases: list[tuple[str, str]] = ()):  # type: ignore[assignment]
        self.log: dict[str, float] = {}
        starts: dict[str, int] = {}
        after: dict[tuple[int, int], int] = {}
        members: dict[str, int] = {}
        for pair, n in bigrams.items():
            a, b = map(script, pair)
            if max(a, b) >= 3:
                after[a, b] = after.get((a, b), 0) + n
                members[pair[1]] = members.get(pair[1], 0) + n
            if self.consistent(pair):
                starts[pair[0]] = starts.get(pair[0], 0) + n
        for pair, n in bigrams.items():
            if self.consistent(pair):
                self.log[pair] = math.log((n + 0.1) / (starts[pair[0]] + 100))
        self.floor = {c: math.log(0.1 / (n + 100)) for c, n in starts.items()}
        self.least = math.log(0.1 / 100)
        # Of each script the share that follows another, and of each letter its share in its script.
        leaving, sizes = {}, {}
        for (a, _), n in after.items():
            leaving[a] = leaving.get(a, 0) + n
        for c, n in members.items():
            sizes[script(c)] = sizes.get(script(c), 0) + n
        self.turn = {(a, b): math.log((after.get((a, b), 0) + 1) / (leaving.get(a, 0) + 5)) for a in (-1, 3, 4) for b in (-1, 3, 4)}
        self.own = {c: math.log((members.get(c, 0) + 0.5) / (sizes.get(script(c), 0) + 100)) for c in (*KANJI, OTHER_KANJI, *map(chr, range(0x30A1, 0x30FB)), "ー")}
        self.alike: dict[str, set[str]] = {}
        pairs = [*zip(CYRILLIC, CYRILLIC_LATIN), *zip(GREEK, GREEK_LATIN), *zip(KANJI, KANJI_KATAKANA), *aliases]
        for a, b in pairs:
            if a != b and len(a) == len(b) == 1 and script(a) != script(b) and -1 not in (script(a), script(b)):
                self.alike.setdefault(a, set()).add(b)
                self.alike.setdefault(b, set()).add(a)

    @staticmethod
    def consistent(pair: str) -> bool:
        a, b = map(script, pair)
        return a == b or -1 in (a, b)

    def step(self, a: str, b: str) -> float:
        if not self.consistent(a + b):
            return -25.0
        return self.log.get(a + b, self.floor.get(a, self.least))

    def japanese_step(self, a: str, b: str) -> float:
        """Inside a script the bigram; from one to another the share of that change and of the letter in its script."""
        own, other = script(a), script(b)
        if own == other == 3:
            return self.log.get(a + b, self.floor.get(a, self.least))
        return self.turn[own, other] + (self.own[b] if other >= 0 else 0.0)

    def options(self, c: str) -> list[str]:
        base, marks = unicodedata.normalize("NFD", c)[0], unicodedata.normalize("NFD", c)[1:]
        found = [c]
        for other in sorted(self.alike.get(base, ())):
            whole = unicodedata.normalize("NFC", other + marks)
            if len(whole) == 1:
                found.append(whole)
        return found

    def best_path(self, word: str, before: str, after: str, step, changed: float) -> str:
        """Viterbi over the lattice of the word's look-alikes. Ties keep the written characters."""
        paths = {before: (0.0, "")}
        for c in word:
            following: dict[str, tuple[float, str]] = {}
            for o in self.options(c):
                cost = 0.0 if o == c else changed
                best = max(((s + step(p, o) + cost, done) for p, (s, done) in paths.items()), key=lambda x: x[0])
                following[o] = (best[0], best[1] + o)
            paths = following
        return max(((s + step(p, after), done) for p, (s, done) in paths.items()), key=lambda x: x[0])[1]

    def word(self, word: str) -> str:
        """The best path through the word's look-alike lattice; words of one script, and words that have no
        single-script reading, stay."""
        if len({script(c) for c in word}) < 2:
            return word
        best = self.best_path(word, "\n", "\n", self.step, self.CHANGED)
        return best if len({script(c) for c in best}) == 1 else word

    def japanese(self, text: str) -> str:
        """Look-alikes in runs of katakana and kanji like it; what stands on both sides belongs to the path."""

        def edge(c: str) -> str:
            return OTHER_KANJI if c and script(c) == 4 else "\n"

        def run(m: re.Match) -> str:
            word, before, after = m[0], edge(text[m.start() - 1 : m.start()]), edge(text[m.end() : m.end() + 1])
            mixed = len({script(c) for c in word}) == 2
            if not mixed and not (len(word) == 1 and script(word) == 3 and before == after == OTHER_KANJI):
                return word
            return self.best_path(word, before, after, self.japanese_step, self.CHANGED_JAPANESE)

        return _JAPANESE.sub(run, text)

    def canonical(self, text: str) -> str:
        if not _SUSPECT.search(text):
            return text
        text = plain(text)
        if _FOREIGN.search(text):
            text = _WORD.sub(lambda m: self.word(m[0]), text)
        return self.japanese(text) if re.search(_BESIDE, text) else text


_SIZE = sum(b - a + 1 for a, b in RANGES) + 2


def _count_bigrams(batches):
    """A partition's bigram counts: letters become small codes, a whole batch is counted at once. Western words of
    several scripts are left out."""
    code, kind = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int8)
    code[0x4E00:0xA000] = _SIZE - 1
    at = 1
    for a, b in RANGES:
        code[a : b + 1] = np.arange(at, at + b - a + 1)
        at += b - a + 1
    for a, b in WESTERN:
        kind[a : b + 1] = [1 + script(chr(o)) for o in range(a, b + 1)]
    total = np.zeros(_SIZE * _SIZE, np.int64)
    for batch in batches:
        text = "\n".join(t for t in batch.column(0).to_pylist() if t)
        raw = np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        own, of = code[raw], kind[raw]
        # A word is a run of western letters; it is mixed if its least and greatest script differ.
        starts = np.flatnonzero(np.diff((of > 0).astype(np.int8), prepend=0))
        if len(starts):
            mixed = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
            bad = np.repeat(mixed, np.diff(np.append(starts, len(of))))
            keep = np.ones(len(of), bool)
            keep[starts[0] :] = ~bad
            fine = keep[:-1] & keep[1:]
        else:
            fine = np.ones(len(of) - 1, bool)
        total += np.bincount((own[:-1].astype(np.int64) * _SIZE + own[1:])[fine], minlength=len(total))
    found = np.flatnonzero(total)
    found = found[found > 0]  # neither side a letter
    yield pa.RecordBatch.from_arrays([pa.array(found // _SIZE, pa.int32()), pa.array(found % _SIZE, pa.int32()), pa.array(total[found])], names=["a", "b", "n"])


def letter_bigrams(texts: DataFrame) -> dict[str, int]:
    """Bigram counts of all texts (one string column); at most (letters of RANGES + 2) squared entries, whatever the input."""
    letters = ["\n"] + [chr(o) for a, b in RANGES for o in range(a, b + 1)] + [OTHER_KANJI]
    rows = spread(texts).mapInArrow(_count_bigrams, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return {letters[r.a] + letters[r.b]: r.n for r in rows}


def alias_pairs(aliases: DataFrame | None) -> list[tuple[str, str]]:
    """(member, representative) pairs of the alias table, a parameter table of some hundred rows."""
    if aliases is None:
        return []
    rows = aliases.select("representative", F.explode("members").alias("member")).where("representative is not null and member is not null").distinct().collect()
    return [(r.member, r.representative) for r in rows]


def fit(texts: DataFrame, aliases: DataFrame | None = None) -> Model:
    """A model from every text of the collection."""
    return Model(letter_bigrams(texts), alias_pairs(aliases))


def _rewrite(model):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            done = [None if t is None else model.value.canonical(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(done, pa.string())], schema=batch.schema.append(pa.field("canonical", pa.string())))

    return run


def rewrite(rows: DataFrame, model: Model) -> DataFrame:
    """rows (with a string column `text`) plus `canonical`. Null stays null; an empty text stays empty."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", canonical string"
    return rows.mapInArrow(_rewrite(shared), schema)


def inconsistent_rows(train: DataFrame, references: DataFrame, aliases: DataFrame) -> DataFrame:
    """(table_name, record_id, text, canonical): rows whose text is not in the consistent form.

    Bigrams come from all texts of both tables. Texts without any suspect character are in the form already and
    never leave the JVM.
    """
    t = train.select(F.lit("train").alias("table_name"), F.col("row_id").alias("record_id"), F.col("text"))
    r = references.select(F.lit("real_references").alias("table_name"), F.col("ref_id").alias("record_id"), F.col("reference").alias("text"))
    both = t.unionByName(r)
    model = fit(both.select("text"), aliases)
    return rewrite(both.where(F.col("text").rlike(SUSPECT)), model).where("canonical <> text")
