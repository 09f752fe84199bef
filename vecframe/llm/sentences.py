"""Sentence units of texts in many scripts, as SQL expressions: mask, mark the ends, split, restore by position.

Every mask replaces one character by one private-use character, so positions in the masked copy are those of the text,
and a unit's own text is restored as a substring. Terminators that end nothing (abbreviations, initials, ordinals,
heading numbers, those inside addresses, code and dotted names) become ``KEPT``, those inside a quotation ``QUOTED``; the last character of a unit becomes ``END``,
or ``GAP`` if it is white space, and the copy is split behind these two. Decimals and file names in lower case need no mask,
since a full stop ends a sentence only before white space, a capital letter or a letter of a script without case. A bare name
of two parts (``System.Text``) has the form of two sentences without a space (``Berlin.The``) and is taken for these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.runtime import spread

KEPT, END, QUOTED, GAP = "\ue000", "\ue001", "\ue002", "\x04"
#: Quotation marks by what they may do, each as one placeholder: open, close, both, and those of Chinese and Japanese.
#: These and ``GAP`` are control characters, for Java tests a class of such characters by one look into a table.
OPENS, SHUTS, BOTH, CORNER, CORNER_SHUTS = "\x01", "\x02", "\x03", "\x05", "\x06"
_MARKS = {"„": OPENS, "«": OPENS, "‹": OPENS, "『": OPENS, "”": SHUTS, "»": SHUTS, "›": SHUTS, "』": SHUTS, "“": BOTH, "「": CORNER, "」": CORNER_SHUTS}

# Abbreviations before which a sentence goes on, whatever follows.
ABBREVIATIONS = (
    "Dr Mr Mrs Ms Prof St Messrs Hon Gen Col Capt Lt Rev Gov Sen Rep vs cf approx esp rev resp incl ed eds al viz "
    "vgl ca bzw evtl ggf inkl exkl sog geb Hr Hrn Fr Dipl Ing Abt Mme Mlle MM env éd "
    "Sr Sra Srta Dra Ud Uds aprox Lic ок см напр им ул гл тыс млн млрд проф акад "
    "κ κα κκ βλ δηλ πρβλ καθ डॉ श्री प्रो पं سم د أ م ص"
).split()
# Abbreviations that are titles in capitals too, and those that are other words with a capital.
TITLES, UNLIKE_CAPITAL = "DR MR MRS PROF".split(), "al ed eds".split()
# Abbreviations with several full stops, each part before one.
SPACED = ["z B", "d h", "u a", "u U", "o ä", "s o", "s u", "p ex", "c -à-d", "p ej", "EE UU", "т е", "т к", "т н", "π χ", "e g", "i e", "n b"]
# Abbreviations before a number.
NUMBERED = (
    "No Nos no Nr nr N p pp P S s Fig Figs fig Sec Secs sec Ch ch Vol vol Art art Abb Tab Kap Bd Anm Zf cap núm pág págs "
    "стр рис табл гл разд σελ εικ αρ κεφ सं पृ ص Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec line Eq eq Ver ver v"
).split()
# Words and months around a German or Scandinavian ordinal.
ORDINAL_BEFORE = "der die das dem den des am im vom zum zur beim seit bis ab jeder jede jedes jeden Der Die Das Dem Den Des Am Im Vom Zum Zur Beim Seit Bis Ab Jeder Jede Jedes Jeden".split()
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# What goes on after a quotation, in scripts without capital letters.
AFTER_QUOTE = (
    r"(?:[,،、，;؛:：]|と|って|という|との|などと|然后|随后|接着|之后|于是|便|就|并|而后|后来|的|[他她它我你您]们?[^。！？，：\x03\x05]{0,4}[问說说道答喊叫写]"
    r"|[^。！？，：\x01-\x06\s]{1,8}(?:问道|说道|答道|喊道|写道|问|说)[。，]|[彼私僕][^。\x05]{0,8}(?:言|尋ね|聞|答え|叫)"
    r"|(?:और|तो|फिर|लेकिन|पर|मगर|तथा|व|ऐसा|यह|कहकर|बोला|बोली|पूछा|कहा)(?![\p{L}\p{M}])|(?:ثم|حين|عندما|قبل|بعد|لكن|قال|قالت|سأل|سألت|وقال|وسأل|وغادر)(?![\p{L}\p{M}])|و(?=\p{L}))"
)
# Verbs that report a quotation after a name.
REPORTS = "asked replied shouted cried exclaimed fragte rief antwortete".split()
# Endings of names of files and products, in capitals.
EXTENSIONS = "JS TS NET IO AI PY CPP PDF TXT CSV TSV JSON XML HTML HTM YAML YML MD DOC DOCX XLS XLSX PPT PPTX ZIP GZ EXE DLL BAT INI LOG SQL JPG JPEG PNG GIF SVG MP3 MP4".split()

#: White space of Unicode.
_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_WORD = r"(?<![\p{L}\p{N}\p{M}])"
_BLANK = r"[\s\p{Z}" + GAP + "]"
_STRONG = "。！？｡।॥؟۔"
_WEAK = ".!?…"
#: A character of these scripts or their marks is in these ranges; a test of ranges costs less than one of scripts.
_DENSE = r"[\x{590}-\x{109F}\x{1100}-\x{11FF}\x{2E80}-\x{A4CF}\x{A960}-\x{A97F}\x{A8E0}-\x{A8FF}\x{AC00}-\x{D7FF}\x{F900}-\x{FDFF}\x{FE70}-\x{FFEF}\x{10000}-\x{10FFFF}]"
# The ranges of scripts without case: Hebrew, Arabic, Devanagari, Thai, Lao, Hangul, Han, Hiragana, Katakana.
_CASELESS_RANGES = (
    r"\x{591}-\x{5F4}\x{600}-\x{60B}\x{60D}-\x{61A}\x{61C}-\x{61E}\x{620}-\x{63F}\x{641}-\x{64A}\x{656}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{950}\x{955}-\x{963}\x{966}-\x{97F}"
    r"\x{E01}-\x{E3A}\x{E40}-\x{EDF}\x{1100}-\x{11FF}\x{2E80}-\x{2FD5}\x{3005}\x{3007}\x{3021}-\x{3029}\x{3038}-\x{303B}\x{3041}-\x{3096}\x{309D}-\x{309F}\x{30A1}-\x{30FA}\x{30FD}-\x{30FF}"
    r"\x{3131}-\x{318E}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A8E0}-\x{A8FF}\x{A960}-\x{A97C}\x{AC00}-\x{D7FB}\x{F900}-\x{FAFF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}"
    r"\x{FF66}-\x{FF6F}\x{FF71}-\x{FF9D}\x{FFA0}-\x{FFDC}\x{20000}-\x{3FFFF}"
)
#: As a class within a class; the first test settles most letters.
_CASELESS = rf"[[^\x00-\x{{58F}}]&&[{_CASELESS_RANGES}]]"
_SHUT = r"\)\]}）】〕》〉’*_"
_QUOTES_SHUT = r"\x02\x03\x06\""
_OPEN = r"[\"\x01\x03\x05‘'(\[{（¿¡*_]*"
#: Not the start of a sentence: a lower-case word (but for names like iOS), or a mark that belongs to what is before.
_NO_START = rf"(?!{_BLANK}*{_OPEN}(?:\p{{Ll}}(?!\p{{Lu}})(?!\p{{Ll}}{{0,30}}{_BLANK}?[{_CASELESS}])|[,;:)\]}}،、，；：]))"
_SAID = rf"(?!{_BLANK}+(?:\p{{Lu}}[\p{{L}}.{KEPT}]*{_BLANK}+){{1,3}}(?:{'|'.join(REPORTS)})(?!\p{{L}}|{_BLANK}*:))"


def _where(test: Column, df: DataFrame, change) -> DataFrame:
    """``df`` with ``m`` changed where ``test`` holds. A step of its own, so that no expression is computed twice."""
    return df.withColumn("m", F.when(test, change(F.col("m"))).otherwise(F.col("m")))


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


def _named(df: DataFrame) -> DataFrame:
    """Marks inside addresses, code without spaces and names that show by their form what they are become ``KEPT``.

    ``\\G`` goes on from the mark before, so an address of any length is masked.
    """
    m = F.col("m")
    part, goes_on = r"[\p{L}\p{N}_]", r"\G(?!^)"
    url = rf"((?i:\b(?:https?|ftp|file|wss?)://|\bwww(?=\.))|{goes_on})([#-\-/-;=@-_a-~]*+)(?<![)\]}}])[.!?](?=[A-Za-z0-9%/&=#~+_$-])"
    df = _where(m.rlike(r"://|(?i:www\.)"), df, lambda c: F.regexp_replace(c, url, "$1$2" + KEPT))
    mail = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.(?=[A-Za-z0-9._%+-]*+@[A-Za-z0-9])", KEPT), rf"(@|{goes_on})([A-Za-z0-9-]++)\.(?=[A-Za-z0-9])", "$1$2" + KEPT)
    df = _where(m.contains("@"), df, mail)
    code = rf"(`(?=[^`\s{GAP}]+`)|{goes_on})([^`\s{GAP}.!?]*+)[.!?](?=[\p{{L}}\p{{N}}_])"
    df = _where(m.rlike(r"`[^`\s]*[.!?][^`\s]*`"), df, lambda c: F.regexp_replace(c, code, "$1$2" + KEPT))

    def dotted(c: Column) -> Column:
        c = F.regexp_replace(c, rf"((?<![\p{{L}}\p{{N}}_.])(?=[\p{{L}}_]{part}*+\.\p{{Lu}}{part}*+\.\p{{Lu}})|{goes_on})({part}++)\.(?=\p{{Lu}})", "$1$2" + KEPT)
        return F.regexp_replace(c, rf"\.(?<={part}\.)(?=\p{{Lu}}{part}*+\(|(?!Ma?c\p{{Lu}})\p{{Lu}}[\p{{Ll}}\p{{N}}]++[\p{{Lu}}_]|{_any(EXTENSIONS)}(?!{part}))", KEPT)

    return _where(m.rlike(r"\.\p{Lu}"), df, dotted)


def _kept(df: DataFrame) -> DataFrame:
    """Full stops that end no sentence become ``KEPT``: those of all kinds but one in one pass."""
    abbreviations = _any([*ABBREVIATIONS, *TITLES, *(w.capitalize() for w in ABBREVIATIONS if w.isascii() and w.islower() and len(w) > 1 and w not in UNLIKE_CAPITAL)])
    numbered = _any([*NUMBERED, *(w.upper() for w in NUMBERED if w.isascii())])
    spaced = [x.split() for x in SPACED]
    first = "|".join(rf"{x[0]}\.(?={_BLANK}{{0,3}}{x[1]}\.)" for x in spaced)
    kinds = [
        rf"(?<={_WORD}{abbreviations}\.)",
        rf"(?={_BLANK}*[\p{{N}}#])(?<={_WORD}{numbered}\.)",
        rf"(?<={_WORD}(?:{first}))",
        rf"(?={_BLANK}+\p{{Lu}})(?<={_WORD}\p{{Lu}}\.)",  # initials
        rf"(?<={_WORD}\p{{N}}{{1,2}}\.)(?={_BLANK}+{_any(MONTHS)})",
        rf"(?<=\p{{N}}\.)(?={_BLANK})(?<={_WORD}{_any(ORDINAL_BEFORE)}{_BLANK}{{1,3}}\p{{N}}{{1,3}}\.)",
        rf"(?<=[\p{{N}}.]\.)(?={_BLANK}+\S)(?<=(?:^|{GAP}){_BLANK}{{0,8}}[\p{{N}}.]{{1,12}}\.)",  # numbers of headings
    ]
    df = _where(F.col("m").contains("."), df, lambda c: F.regexp_replace(c, rf"\.(?:{'|'.join(kinds)})", KEPT))
    later = "|".join(rf"{x[i]}{KEPT}{_BLANK}{{0,3}}{x[i + 1]}" for x in spaced for i in range(len(x) - 1))
    return _where(F.col("m").contains(KEPT), df, lambda c: F.regexp_replace(c, rf"\.(?<={KEPT}{_BLANK}{{0,3}}\S{{1,4}}\.)(?<=(?:{later})\.)", KEPT))


def _quoted(df: DataFrame) -> DataFrame:
    """Terminators inside a quotation, which is closed within a paragraph, become ``QUOTED``.

    Whether a mark opens one is asked once; ``\\G`` goes on from the terminator before, so a quotation of any length is one.
    """
    ends = f"{_STRONG}{_WEAK};"
    m = F.col("m")

    def put(opens: str, marks: str, shuts: str, test: Column) -> None:
        nonlocal df
        pattern = rf"({opens}(?=[^{marks}]*+{shuts})|\G(?!^))([^{marks}{ends}]*+)[{ends}]"
        df = _where(test, df, lambda c: F.regexp_replace(c, pattern, "$1$2" + QUOTED))

    put(r"[\x01\x03]", r"\x01-\x04", r"[\x02\x03]", m.contains(OPENS) | m.contains(BOTH))
    put(r"\x05", r"\x04-\x06", r"\x06", m.contains(CORNER))
    put(rf"\"(?<![\p{{L}}\p{{N}}{_WEAK}{_STRONG},)]\")", r"\"\x04", r"\"(?![\p{L}\p{N}])", m.contains('"'))
    return df


def _ended(df: DataFrame) -> DataFrame:
    """The last character of each unit becomes ``END``, or ``GAP`` if it is white space."""
    last = rf"(?:{_BLANK}*$|{_BLANK}*{GAP})"
    shut = rf"[{_SHUT}]{{0,4}}"
    m, dense = F.col("m"), F.col("dense")

    def put(pattern: str, test: Column | None = None, mark: str = END) -> None:
        nonlocal df
        change = lambda c: F.regexp_replace(c, pattern, mark)
        df = df.withColumn("m", change(m)) if test is None else _where(test, df, change)

    # terminators of scripts that have their own
    put(rf"[{_STRONG}{_WEAK}{_SHUT}](?<=[{_STRONG}][{_STRONG}{_WEAK}]{{0,6}}{shut})(?![{_STRONG}{_WEAK}{_SHUT}])", dense)
    # full stop, exclamation and question marks and ellipses before the end, or white space and no lower-case word
    here = rf"[{_WEAK}{_SHUT}\x02\x03\x06\"](?={_BLANK}|$)(?<=[{_WEAK}]{shut}[\x02\x03\x06\"]{{0,2}}{shut})(?![{_WEAK}{_SHUT}\x02\x06])"
    put(rf"{here}(?:(?={last})|(?={_BLANK}){_NO_START})")
    put(rf"[.!?](?<=[{_CASELESS}\p{{M}}][.!?]{{1,4}})(?={_BLANK}+[\p{{L}}\p{{N}}])", dense)
    # a missing space: a capital after a small letter, digit or closing mark; a letter of a script without case
    single = r"(?<![.…][.…])(?<!…)"
    capital = r"(?=[\"\x01\x03‘(¿¡]*\p{Lu})"
    after = rf"(?<=[\p{{Ll}}\p{{N}}\p{{Lo}}\p{{M}})\]`%][.!?]{{0,2}}\.){capital}|(?<=\p{{Lu}}{{2}}\.)(?=\p{{Lu}}\p{{Ll}})|(?<=[!?])(?:{capital}|(?=[\x01\x05¿¡]))"
    put(rf"[.!?](?![\s\p{{Z}}]){single}(?:{after})")
    put(rf"[{_WEAK}{_SHUT}]{single}(?<=[\p{{L}}\p{{M}}\p{{N}}`)][.!?]{{1,3}}{shut})(?=[\x01\x03\x05]?[{_CASELESS}])", dense)
    # a quotation that ends its sentence
    quote = rf"[{_QUOTES_SHUT}{_SHUT}](?<={QUOTED}[\p{{Zs}}]?[{_QUOTES_SHUT}]{{1,2}}{shut})(?![{_SHUT}{_STRONG}{_WEAK}]|[{_QUOTES_SHUT}](?![\p{{L}}\p{{N}}]))"
    put(rf"{quote}(?:(?={last})|(?!{_BLANK}*{AFTER_QUOTE}){_NO_START}{_SAID}(?={_BLANK}|[\"\x01\x03\x05‘(¿¡]*[\p{{Lu}}{_CASELESS}])|(?={_BLANK}*\p{{Ll}})(?<=[{_CASELESS}]{QUOTED}.{{1,3}})(?!{_BLANK}*{AFTER_QUOTE}))", m.contains(QUOTED))
    # the Greek question mark
    put(rf"[;\x{{37E}}](?<=\p{{IsGreek}}[^!?;{END}]{{0,60}};|\x{{37E}})(?={_BLANK}*(?:$|{GAP})|{_BLANK}+{_OPEN}[\p{{Lu}}\p{{N}}]|\p{{Lu}})", F.col("greek") & (m.contains(";") | m.contains("\u037e")))
    # scripts without sentence ends: a space between two of their words
    put(rf"[\s\p{{Z}}](?<=[\p{{IsThai}}\p{{IsLao}}][\s\p{{Z}}])(?=[\s\p{{Z}}]*[\p{{IsThai}}\p{{IsLao}}])", F.col("spaced"), GAP)
    return df


def marked(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``m``: a copy of the text, character by character, in which each unit's last character is ``END`` or ``GAP``."""
    used = KEPT + END + QUOTED + GAP + OPENS + SHUTS + BOTH + CORNER + CORNER_SHUTS
    text = F.col(text_col)
    c = F.when(text.rlike(f"[{used}{''.join(_MARKS)}]"), F.translate(text, used + "".join(_MARKS), "x" * len(used) + "".join(_MARKS.values()))).otherwise(text)
    c = F.regexp_replace(c, r"[\n\r\x{2029}](?:(?<=\n)(?=[\s\p{Z}]*\n)|(?<=\x{2029})|(?<=\r)(?=[^\S\n\r]*\r))", GAP)
    df = _named(df.withColumn("m", c))
    wide = F.octet_length(text) > F.length(text)
    df = _kept(df).withColumns({"dense": wide & text.rlike(_DENSE), "spaced": wide & text.rlike(r"[\x{E00}-\x{EFF}]"), "greek": wide & text.rlike(r"[\x{370}-\x{3FF}\x{1F00}-\x{1FFF}]")})
    return _ended(_quoted(df))


def _starts(sizes: Column, block: int = 1024) -> Column:
    """The sum of the sizes before each one. Sums are kept by blocks, so that no list grows long by single steps."""

    def sums(part: Column, at: Column) -> Column:
        none = F.struct(F.array().cast("array<int>").alias("before"), at.alias("at"))
        return F.aggregate(part, none, lambda a, n: F.struct(F.concat(a["before"], F.array(a["at"])).alias("before"), (a["at"] + n).alias("at")), lambda a: a["before"])

    numbers = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / F.lit(block)).cast("int"))
    blocks = F.transform(numbers, lambda b: F.slice(sizes, b * block + 1, block))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))
    return F.flatten(F.zip_with(blocks, sums(totals, F.lit(0)), sums))


def sentence_units(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start_pos, end_pos): the sentence units of each text, in code points from 0, the end exclusive.

    Units have no white space at either end and together hold all text that is not blank. Null, empty and blank texts
    have none; an empty table gives no rows. A row is a text of its own, even if its id is null or occurs again.
    Positions are summed up within the row, so nothing is shuffled.
    """
    rows = marked(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''"), "text")
    split = rows.select("id", F.split("m", f"(?<=[{END}{GAP}])").alias("pieces"))
    sized = split.select("id", "pieces", F.transform("pieces", F.length).alias("sizes"))
    pieces = sized.select("id", F.explode(F.arrays_zip("pieces", _starts(F.col("sizes")).alias("starts"))).alias("p")).select("id", F.col("p.pieces").alias("piece"), F.col("p.starts").alias("before"))
    blank = F.lit(_WHITE + GAP)
    tail = F.ltrim("piece", blank)
    units = pieces.select("id", (F.col("before") + F.length("piece") - F.length(tail)).alias("start_pos"), F.length(F.rtrim(tail, blank)).alias("body")).where("body > 0")
    return units.select("id", "start_pos", (F.col("start_pos") + F.col("body")).alias("end_pos"))


def p8_units(docs: DataFrame) -> DataFrame:
    return sentence_units(spread(docs.select("doc_id", "text")), "doc_id", "text")
