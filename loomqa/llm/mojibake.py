"""Text decoded with the wrong encoding: detection and repair by best-first search."""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Single-byte encodings a UTF-8 text may have been read in, the multi-byte
#: ones, and the encodings of Cyrillic that are taken for each other or for Latin ones.
SINGLE_BYTE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-15", "cp1253", "cp1254")
MULTI_BYTE = ("cp932", "gb18030")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
LATIN = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")
#: Everyday words of Russian, Ukrainian, Bulgarian, Serbian, Macedonian and
#: Belarusian, from which the letter model below is trained when the module is loaded.
CYRILLIC_WORDS = (
    "и в не на я быть он что это она этот но они мы весь который из у который свой год человек время рука дело жизнь день другой слово место вопрос сторона страна мир работа после город вода "
    "земля если уже или когда только большой новый первый можно также потому сказать говорить знать стать есть хотеть видеть идти стоять думать спросить жить смотреть понимать делать общество "
    "государственный развитие отношение история система возможность общий щит объект съезд подъём "
    "є й що як цей вона вони який коли тільки людина життя місце країна світ робота після місто земля якщо також щастя їжа їх своє мова ґрунт український державний розвиток більше під між "
    "съм се да че от за това тя които когато само човек живот място страна свят работа след град вода земя ако също български държавен развитие между първи още "
    "је у који они кад само људи живот мјесто земља свет посао после град ако такође њега ђак ћерка џеп љубав његов српски државни развој између "
    "ќе сум ѓон ѕвезда јазик македонски человекот "
    "ён яна што гэта калі ўсё чалавек жыццё горад дзяржаўны беларускі мова"
)
_COMMON_MARKS = set("“”‘’„«»–—…€°©®£§·¿¡•™²³½№ \u200b\u200d\ufeff\ufe0f")
#: Blocks of letters that texts are commonly written in, with a cost a letter; letters elsewhere cost 8.
_LETTER_BLOCKS = ((0x370, 0x3FF, 1.6), (0x531, 0x587, 1.6), (0x591, 0x6FF, 1.6), (0x900, 0xDFF, 1.6), (0xE00, 0xE7F, 1.6), (0x10A0, 0x10FF, 1.6), (0x1200, 0x137F, 1.6), (0x1E00, 0x1EFF, 1.2), (0x2100, 0x214F, 3.0), (0x3040, 0x30FF, 1.0), (0xAC00, 0xD7A3, 1.4), (0xFB00, 0xFB06, 2.5), (0xFF10, 0xFF9F, 2.5))
#: Letters of Vietnamese, Romanian, Azerbaijani and Danish beyond the first blocks, marks
#: that are written after a letter, and blocks of signs.
_FURTHER_LETTERS = set("ƏəƠơƯưȘșȚțǺǻǼǽǾǿ")
_MARKS_AFTER = set(map(chr, (*range(0x300, 0x30D), 0x323, 0x326, 0x327, 0x328, 0x331)))
_SIGN_BLOCKS = ((0x2010, 0x2027), (0x2030, 0x205E), (0x2070, 0x20CF), (0x2100, 0x22FF), (0x2300, 0x23FF), (0x25A0, 0x27BF), (0x3000, 0x303F), (0xFF00, 0xFF65), (0x1F000, 0x1FAFF))
#: Lead bytes of the common half of each Chinese, Japanese and Korean character set.
_COMMON_HAN = (("gb2312", 0xB0, 0xD7), ("big5", 0xA4, 0xC6), ("shift_jis", 0x88, 0x97), ("euc_kr", 0xCA, 0xFD))
_CONT = "[\x80-\xbf]"
_UTF8_RUN = re.compile(f"[\xc2-\xdf]{_CONT}|\xe0[\xa0-\xbf]{_CONT}|[\xe1-\xec\xee\xef]{_CONT}{{2}}|\xed[\x80-\x9f]{_CONT}|\xf0[\x90-\xbf]{_CONT}{{2}}|[\xf1-\xf3]{_CONT}{{3}}|\xf4[\x80-\x8f]{_CONT}{{2}}")
_RUN = re.compile("[^\x00-\x7f]+")
_ENTITY = re.compile(r"&(?:#[0-9]{1,6}|#[xX][0-9a-fA-F]{1,5}|[A-Za-z][A-Za-z0-9]{1,7});")
_SEGMENT = re.compile(r"[^\n.!?]*(?:[.!?]+[ \t]*|\n+|$)")


def _byte_table(encoding: str) -> dict[int, str]:
    """Character -> the byte, as a Latin-1 character, that it was read from. Undefined bytes
    of a table are taken as control characters, as lenient decoders do."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(encoding))] = chr(b)
        except UnicodeDecodeError:
            table.setdefault(b, chr(b))
    return table


_BYTES = {e: _byte_table(e) for e in SINGLE_BYTE}
_KNOWN = {e: re.compile("[" + "".join(re.escape(chr(c)) for c in t) + "]+") for e, t in _BYTES.items()}
#: encode in one, decode in the other: character -> character
_CROSS = {}
for _a in (*CYRILLIC, *LATIN):
    for _b in CYRILLIC:
        if _a != _b:
            _t = {}
            for _byte in range(0x80, 0x100):
                try:
                    _t[ord(bytes([_byte]).decode(_a))] = bytes([_byte]).decode(_b)
                except UnicodeDecodeError:
                    pass
            _CROSS[_a, _b] = _t
del _a, _b, _t, _byte

_VOWELS, _SIGNS = set("аеёиоуыэюяіїєөүұәѣўј"), set("ьъ")


def _kind(c: str) -> str:
    return " " if c == " " else "v" if c in _VOWELS else "s" if c in _SIGNS else "c"


def _letter_model(words: str) -> dict[str, dict[str, float]]:
    """Letter -> next letter -> cost in nats; a blank is the edge of a word. Counts of pairs are
    smoothed by the kinds of letters (vowel, consonant, sign), so a pair that was never seen
    costs by how common its kinds and its second letter are."""
    letters = [chr(c) for c in range(0x430, 0x460)] + [chr(c) for c in range(0x461, 0x530, 2)] + list("ӏӂӄӆӈӊӌӎ")
    pairs, kinds, single = Counter(), Counter(), Counter()
    for w in words.split():
        w = f" {w} "
        pairs.update(zip(w, w[1:]))
        kinds.update((_kind(x), _kind(y)) for x, y in zip(w, w[1:]))
        single.update(w[1:])
    letters = list(dict.fromkeys([" ", *letters]))
    by_kind, first, kind_of = Counter(), Counter(), Counter()
    for c in letters:
        by_kind[_kind(c)] += single[c] + 0.3
    for (x, y), n in pairs.items():
        first[x] += n
    for (x, y), n in kinds.items():
        kind_of[x] += n
    weight = 10.0
    return {
        x: {
            y: -math.log((pairs[x, y] + weight * (kinds[_kind(x), _kind(y)] + 0.5) / (kind_of[_kind(x)] + 2.0) * (single[y] + 0.3) / by_kind[_kind(y)]) / (first[x] + weight))
            for y in letters
        }
        for x in letters
    }


_NEXT = _letter_model(CYRILLIC_WORDS)
#: Cost in nats a letter of a Cyrillic text that reads naturally, at most; garbled text costs 4.4 or more.
NATURAL = 3.8
_CYR_WORD = re.compile("[Ѐ-ԯ]+")


@lru_cache(maxsize=65536)
def _word_nats(word: str) -> float:
    """Cost of a Cyrillic word: its letters one after the other, and 3 for each capital after a small letter."""
    w = f" {word.lower()} "
    total = sum(_NEXT.get(x, {}).get(y, 8.0) for x, y in zip(w, w[1:]))
    return total + sum(3.0 for x, y in zip(word, word[1:]) if y.isupper() and x.islower())


def _cyrillic_nats(text: str) -> tuple[float, int, int]:
    """Cost, number of letters and of different letters of the Cyrillic words of a text. A word in
    capitals of up to three letters (an abbreviation) says nothing."""
    words = [w for w in _CYR_WORD.findall(text) if len(w) > 3 or not w.isupper()]
    if not words:
        return 0.0, 0, 0
    return sum(map(_word_nats, words)), sum(map(len, words)), len(set("".join(words).lower()))


def _as_utf8(m: re.Match) -> str:
    return m.group().encode("latin-1").decode("utf-8")


@lru_cache(maxsize=65536)
def _run_as_utf8(run: str, encoding: str) -> str:
    """A run of characters of ``encoding`` read as UTF-8; unchanged unless nearly all of it is valid."""
    raw = run.translate(_BYTES[encoding])
    found = list(_UTF8_RUN.finditer(raw))
    if 4 * sum(u.end() - u.start() for u in found) < 3 * len(run):
        return run
    out, last = [], 0
    for u in found:
        out += [run[last : u.start()], _as_utf8(u)]
        last = u.end()
    return "".join(out) + run[last:]


def read_as_utf8(segment: str, encoding: str) -> str:
    """Encode the runs of non-ASCII characters in ``encoding`` and decode what is then valid UTF-8."""
    return _KNOWN[encoding].sub(lambda m: _run_as_utf8(m.group(), encoding), segment)


def _read_multi_byte(segment: str, encoding: str) -> str:
    """Runs of non-ASCII characters encoded in a multi-byte encoding and read as UTF-8, where
    at least three quarters of a run's bytes, and two characters, are valid."""

    def read(m: re.Match) -> str:
        try:
            raw = m.group().encode(encoding).decode("latin-1")
        except UnicodeEncodeError:
            return m.group()
        found = list(_UTF8_RUN.finditer(raw))
        if len(found) < 2 or 4 * sum(u.end() - u.start() for u in found) < 3 * len(raw):
            return m.group()
        out, last = [], 0
        for u in found:
            out += ["\ufffd" * (u.start() > last), _as_utf8(u)]
            last = u.end()
        return "".join(out) + "\ufffd" * (last < len(raw))

    return _RUN.sub(read, segment)


@lru_cache(maxsize=4096)
def _common_han(c: str) -> bool:
    for encoding, low, high in _COMMON_HAN:
        try:
            if low <= c.encode(encoding)[0] <= high:
                return True
        except UnicodeEncodeError:
            pass
    return False


@lru_cache(maxsize=4096)
def _char_cost(c: str) -> float:
    """How unlikely a non-ASCII character other than a Cyrillic letter is by itself."""
    o = ord(c)
    if o == 0xFFFD:
        return 3.0
    if 0x80 <= o <= 0x9F:
        return 6.0
    if c in _COMMON_MARKS:
        return 1.2 if c != "\xa0" else 0.5
    kind = unicodedata.category(c)
    if o < 0x180:
        return (1.0 if c in "éèêëàâáãäåçíîïìóôõöòúûùüñßæøœ" or c in "ÉÈÊÀÂÁÃÄÅÇÍÎÓÔÖÚÜÑ" else 1.4) if kind[0] == "L" else 2.5
    if 0x2500 <= o <= 0x25FF:
        return 3.0
    if 0x4E00 <= o <= 0x9FFF:
        return 1.2 if _common_han(c) else 3.5
    if c in _FURTHER_LETTERS:
        return 1.4
    if kind[0] == "L":
        return next((cost for a, b, cost in _LETTER_BLOCKS if a <= o <= b), 8.0)
    if kind[0] == "M":
        return 1.0 if any(a <= o <= b for a, b, _ in _LETTER_BLOCKS) else 1.5 if c in _MARKS_AFTER or 0x20D0 <= o <= 0x20FF or 0xFE00 <= o <= 0xFE2F else 8.0
    if kind[0] in "SP":
        return 2.0 if o < 0x250 or any(a <= o <= b for a, b in _SIGN_BLOCKS) or kind[0] == "P" and any(a <= o <= b for a, b, _ in _LETTER_BLOCKS) else 8.0
    return 3.0 if kind[0] == "Z" or kind == "Cf" else 8.0


@lru_cache(maxsize=4096)
def _script(c: str) -> int:
    """0 Latin, 1 Cyrillic, 2 Chinese and Japanese, else the block of the letter."""
    o = ord(c)
    if c < "ɐ" or 0x1E00 <= o <= 0x1EFF:
        return 0
    if "Ѐ" <= c <= "ԯ":
        return 1
    return 2 if 0x3040 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF else 3 + next((i for i, (a, b, _) in enumerate(_LETTER_BLOCKS) if a <= o <= b), 99)


def plausibility_cost(segment: str) -> float:
    """Cost of a segment: low for text that people write. ASCII is free but for entities;
    Cyrillic words cost by the letter model, other characters by kind, and more
    beside one they rarely stand beside."""
    total = 4.0 * len(_ENTITY.findall(segment)) if "&" in segment else 0.0
    before, capitals = "", 0
    for c in segment:
        if c > "\x7f":
            if not "Ѐ" <= c <= "ԯ":
                total += _char_cost(c)
            if before:
                if c == before:
                    total += 0.5
                elif c.isalpha() and before.isalpha():
                    if before > "\x7f" and c < "ɐ" and before < "ɐ":
                        total += 1.5  # accented letters side by side
                    if c.isupper() and before.islower():
                        total += 1.2  # a capital inside a word
                    if c.islower() and before.isupper() and capitals > 1:
                        total += 3.0  # a small letter after capitals
                    if _script(c) != _script(before):
                        total += 3.0  # scripts mixed in a word
                elif c.isalpha() and before > "\x7f" and unicodedata.category(before)[0] == "S":
                    total += 0.5
        elif before > "\x7f" and c.isalpha() and before.isalpha() and before > "˿":
            total += 2.0
        before, capitals = c, capitals + 1 if c.isupper() else 0
    return total + sum(max(0.35 * len(w), 0.35 * (_word_nats(w) - len(w))) for w in _CYR_WORD.findall(segment))


def _unescape(m: re.Match) -> str:
    body = m.group()[1:-1]
    code = name2codepoint.get(body, 0) if body[0] != "#" else int(body[2:], 16) if body[1] in "xX" else int(body[1:])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m.group()


def _unescaped(segment: str) -> str:
    """The segment with all entities, also escaped ones, resolved. Each step makes it shorter."""
    while "&" in segment:
        out = _ENTITY.sub(_unescape, segment)
        if out == segment:
            break
        segment = out
    return segment


#: Letters a change within single-byte encodings is judged on, at least.
LEAST_LETTERS = 8
#: Cost in nats of a letter that stands in a word of accented Latin letters or marks only.
_BYTE_NATS = 6.0
_BYTE_WORD = {a: re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(t)) + "]{2,}") for a in LATIN for t in [_CROSS[a, "cp1251"]]}
_LETTERS = re.compile(r"[^\W\d_]+")


def _letters(text: str) -> int:
    """Cyrillic letters of a text."""
    return sum(map(len, _CYR_WORD.findall(text)))


def _bytes_only(segment: str, encoding: str) -> int:
    """Characters in words that are made of the upper half of a Latin code page alone, if nine in
    ten of the non-ASCII characters stand in such words; else 0."""
    held = sum(len(w) for w in _BYTE_WORD[encoding].findall(segment))
    if held < LEAST_LETTERS:
        return 0
    apart = sum(1 for w in _LETTERS.findall(segment) if not w.isascii() and any(c < "\x80" for c in w) for c in w if c > "\x7f")
    return held if 10 * apart <= held else 0


def swap_gain(before: str, after: str, encoding: str) -> float:
    """By how many nats a letter ``after`` reads more naturally than ``before``, over what chance
    allows for a text of its length (0.55 and 8 nats in all); 0 or less is no case. Judged on
    at least eight letters, five of them different."""
    nats, n, kinds = _cyrillic_nats(after)
    if n < LEAST_LETTERS or kinds < 5:
        return -1.0
    if encoding in LATIN:
        was = _BYTE_NATS * n
        if nats > 4.4 * n:
            return -1.0
    else:
        was, m, _ = _cyrillic_nats(before)
        if _letters(before) > _letters(after):  # letters became marks
            return -1.0
        was = was + 4.5 * (n - m) if m < n else was * n / m
    return (was - nats) / n - 0.55 - 8.0 / n


def _swaps(segment: str) -> Iterator[tuple[tuple[str, str], str]]:
    """((encode in, decode in), text) of the changes between single-byte encodings that pay."""
    cyr = bool(_CYR_RUN.search(segment))
    lat = {a for a in LATIN if _bytes_only(segment, a)} if sum(map(len, _RUN.findall(segment))) >= LEAST_LETTERS else set()
    for (a, b), t in _CROSS.items():
        if a in lat or cyr and a in CYRILLIC:
            out = segment.translate(t)
            if out != segment and swap_gain(segment, out, a) > 0:
                yield (a, b), out


def neighbours(word: str) -> Iterator[str]:
    """Texts one operation away: an unescape, or an encode with a decode as UTF-8."""
    if "&" in word:
        yield _ENTITY.sub(_unescape, word)
    for e in SINGLE_BYTE:
        out = read_as_utf8(word, e)
        if out != word:
            yield out
    if _EAST.search(word):
        for e in MULTI_BYTE:
            out = _read_multi_byte(word, e)
            if out != word:
                yield out


_CYR_RUN = re.compile("[Ѐ-ԯ]{2,}")
_EAST = re.compile("[\u3040-\u30ff\u4e00-\u9fff\uff61-\uff9f]")
#: Fixed value: two replacement characters written in UTF-8 and read in a Chinese encoding.
_LOST_GBK = "锟斤拷"

#: What an operation must gain at least.
STEP = 0.5


@lru_cache(maxsize=65536)
def restored_word(word: str) -> str:
    """The cheapest text that unescapes and reads as UTF-8 lead to from a word.

    Best-first search: the frontier is ordered by cost plus a small price a step
    and visited states are hashed. There is no bound on the states: each operation
    makes the text shorter, so they are finite, and a state is left out only if
    the price of one more step is already more than the best total."""
    best, total = word, plausibility_cost(word)
    frontier = [(total, 0, word)]
    seen = {hash(word)}
    while frontier:
        _, depth, s = heapq.heappop(frontier)
        price = STEP * (depth + 1)
        if price >= total:  # no text costs less than nothing
            continue
        for t in neighbours(s):
            h = hash(t)
            if h in seen:
                continue
            seen.add(h)
            cost = plausibility_cost(t) + price
            if cost < total:
                best, total = t, cost
            heapq.heappush(frontier, (cost, depth + 1, t))
    return best


#: What the operations of :func:`neighbours` may change: letters, characters beyond ASCII and
#: entities in a row. The cost of a segment is the sum over them.
_WORD = re.compile(r"(?:[A-Za-z]|[^\x00-\x7f]|&#?\w+;)+")


def restore(segment: str) -> tuple[str, float]:
    """The cheapest text reachable, and by how much cheaper it is.

    The best-first search goes on over the whole segment, whose operations are the
    best reading of each of its words (costs add up over words, so each
    has a search of its own) and the changes between single-byte encodings, which
    must pay over the whole segment. It ends when nothing is left in the frontier."""
    start = plausibility_cost(segment)
    best, total = segment, start
    frontier = [(start, 0, segment)]
    seen = {hash(segment)}
    while frontier:
        _, depth, s = heapq.heappop(frontier)
        price = STEP * (depth + 1)
        if price >= total:
            continue
        for t in (_WORD.sub(lambda m: restored_word(m.group()), s), *(t for _, t in _swaps(s))):
            h = hash(t)
            if h in seen:
                continue
            seen.add(h)
            cost = plausibility_cost(t) + price
            if cost < total:
                best, total = t, cost
            heapq.heappush(frontier, (cost, depth + 1, t))
    return best, start - plausibility_cost(best)


@lru_cache(maxsize=65536)
def _odd_run(run: str) -> bool:
    """Whether a run of non-ASCII characters may be bytes of UTF-8."""
    return any(_run_as_utf8(x, e) != x for e in SINGLE_BYTE for x in _KNOWN[e].findall(run))


def _suspicious(segment: str) -> bool:
    """Necessary test for a segment that an operation could change for the better."""
    segment = _unescaped(segment)
    if "\ufffd" in segment or _LOST_GBK in segment:
        return True
    runs = [r for r in _RUN.findall(segment) if len(r) > 1]
    if any(map(_odd_run, runs)):
        return True
    if _EAST.search(segment) and any(_read_multi_byte(segment, e) != segment for e in MULTI_BYTE):
        return True
    nats, n, _ = _cyrillic_nats(segment)
    if n and nats > NATURAL * n and next(_swaps(segment), None):
        return True
    apart = [r for r in runs if not "Ѐ" <= r[0] <= "ԯ" and r[0] < "\u3000"]
    return sum(map(len, apart)) >= LEAST_LETTERS and any(_bytes_only(segment, a) for a in LATIN)


def repair(text: str, margin: float = 0.9) -> tuple[bool, bool, str]:
    """(garbled, restored, text): whether any part was decoded wrongly, whether all of it could be
    restored, and the text with the restored parts in place.

    A text is judged sentence by sentence. Entities alone are escapes and no
    wrong decoding: they count only where the text they stand for is garbled.
    Where sentences were read in a wrong single-byte encoding, short ones beside
    them, which could not be judged alone, are read like them if that is better."""
    if text.isascii() and "&" not in text:
        return False, False, text
    out, garbled, lost, swaps = [], False, False, Counter()
    for m in _SEGMENT.finditer(text):
        s = m.group()
        if s and (not s.isascii() or "&" in s) and _suspicious(s):
            # unescaping alone proves no wrong decoding: its own gain doesn't count
            plain = _unescaped(s)
            best, _ = restore(s)
            if best != plain and plausibility_cost(plain) - plausibility_cost(best) > margin:
                garbled = True
                swaps.update(op for op, t in _swaps(plain) if t == best)
                s = best
            if "\ufffd" in s or _LOST_GBK in s:
                garbled = lost = True
        out.append(s)
    if swaps:
        (a, b), _ = swaps.most_common(1)[0]
        for i, s in enumerate(out):
            if s == "" or s.isascii():
                continue
            t = s.translate(_CROSS[a, b])
            nats, n, _ = _cyrillic_nats(t)
            was, m, _ = _cyrillic_nats(s)
            if a in LATIN:
                was, m = (_BYTE_NATS * n, n) if not m and not re.search("[a-zA-Z][^\x00-\x7f]|[^\x00-\x7f][a-zA-Z]", s) else (0.0, n)
            elif m > n > 0:
                was, m = was * n / m, n
            if n and _letters(s) <= _letters(t) and was + 4.5 * (n - m) - nats > 0.15 * n:
                out[i] = t
    return garbled, garbled and not lost, "".join(out)


def find_garbled(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, restored, original for each garbled row.

    ``original`` is the restored text, or the text as far as it could be
    restored where bytes were lost (``restored`` false). One pass without a
    shuffle; rows of plain ASCII without entities are dropped in the
    scan's stage before Python. Null and empty texts give no rows; a text is
    processed as a whole, sentence by sentence."""
    slim = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]|&#?\w+;"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ok, texts = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                garbled, restored, best = repair(t)
                if garbled:
                    ids.append(d)
                    ok.append(restored)
                    texts.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ok, pa.bool_()), pa.array(texts, pa.string())], names=["doc_id", "restored", "original"])

    return slim.mapInArrow(run, "doc_id long, restored boolean, original string")
