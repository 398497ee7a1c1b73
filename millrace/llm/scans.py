"""Problem 1: repair of text read from scanned pages, in SQL over lines.

Running headers repeat when digits are masked and look-alike letters fall together; page numbers stand at the edges of
pages and count up. Words are grouped by a skeleton that maps look-alike glyphs to one letter; within a group, forms that
clean text doesn't know give way to the form it knows, first the one that follows the same word elsewhere. Broken words
are joined unless clean text knows them with a hyphen, and windows over the lines put paragraphs together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.config import with_settings
from millrace.session import materialize

#: Glyphs that are taken for each other, and what stands for them in a skeleton.
LOOKALIKES = {
    "0": "o", "ο": "o", "о": "o", "1": "i", "l": "i", "|": "i", "ı": "i", "!": "i", "5": "s", "$": "s", "ѕ": "s", "α": "a", "а": "a", "c": "e", "е": "e", "ε": "e", "с": "e", "f": "t", "τ": "t",
    "h": "u", "b": "u", "8": "u", "6": "u", "υ": "u", "9": "g", "q": "g", "2": "z", "ν": "v", "р": "p", "ρ": "p", "у": "y", "η": "n", "κ": "k",
    "ä": "a", "á": "a", "à": "a", "â": "a", "ã": "a", "ö": "o", "ó": "o", "ô": "o", "õ": "o", "ü": "u", "ú": "u", "é": "e", "è": "e", "ê": "e", "í": "i", "ï": "i", "ç": "e", "ñ": "n",
}
#: Letters that are taken for one or two others, in this order and after the above.
PAIRS = {"ﬁ": "ti", "ﬂ": "ti", "nn": "rm", "rn": "m", "vv": "w", "ei": "d", "ii": "u", "iu": "ui"}
#: Han characters that are taken for each other.
HAN_LOOKALIKES = (
    "比此 同问 由甲 由田 已己 已巳 而丽 天夭 天夫 天无 未末 自白 自目 人入 人八 项顶 期朗 日曰 日目 处外 例列 约的 规现 土士 大太 大犬 千干 干于 木本 木术 间问 间闻 待侍 往住 "
    "折拆 折析 拨拔 货贷 代伐 名各 今令 设没 师帅 买卖 几九 力刀 王玉 王主 休体 免兔 住佳 持特 徒徙 治冶 署暑 遗遣 准淮 村材 仓仑 微徽 园圆 密蜜 检险 延廷 候侯 晴睛 辩辨 乌鸟 万方 历厉 户尸 牛午 石右 申甲 与写 开升 从丛 又叉 了子 刃刀 办为 史吏 市巾 古舌 旧归 他地 作伟 低抵 何向 提堤 季李 传转"
)
WORD = r"[\p{L}\p{N}|$]+(?:[-'’][\p{L}\p{N}|$]+)*"
BLANKS = r" \t\r\f\x0B"
#: A record may be scanned where no line is longer than this, as lines are filled to a page's width.
WIDEST = 120
#: A form is wrong where clean text has its group's best form so many times as often.
RATIO = 40
#: So many rival forms, of a few letters each, are sent to every task (about 30 MB).
MOST_FORMS = 300_000


def skeleton(word: Column, swap: bool = False) -> Column:
    """What is left of a word in lower case when look-alike glyphs are mapped to one.

    Two rules compete for the same strokes (cl for d, ii for u); ``swap`` has the second go first.
    """
    found = F.translate(F.lower(word), "".join(LOOKALIKES), "".join(LOOKALIKES.values()))
    for pair, one in sorted(PAIRS.items(), key=lambda p: p[0] == "ei") if swap else PAIRS.items():  # one after the other: each works on what the one before left
        found = F.replace(found, F.lit(pair), F.lit(one))
    return found


def _skeletons(word: Column) -> Column:
    return F.explode(F.array_distinct(F.array(skeleton(word), skeleton(word, swap=True))))


def _records(records: DataFrame, config: DataFrame) -> DataFrame:
    """``id``, ``text``, ``filled``: whether lines were read from pages, as far as source and line lengths tell."""
    known = with_settings(records.select("id", "source", "text_content").where("id is not null and text_content is not null"), config, "pdf_parse_mode")
    text = F.col("text_content")
    filled = (F.lower(F.trim("cfg_pdf_parse_mode")) != "text") & text.rlike(r"\n[^\n]*\n[^\n]*\n") & ~text.rlike(rf"(?:^|\n)[^\n]{{{WIDEST + 1}}}")
    return known.select("id", F.col("text_content").alias("text"), filled.alias("filled"))


def _counted(clean: DataFrame) -> DataFrame:
    """What stands between blanks in clean text, in lower case, and Han look-alikes with their neighbours (behind a mark): ``token``, ``n``.

    One pass over the text; it is cut at blanks, which is cheap, and words are found in the distinct tokens afterwards.
    """
    text = F.lower("text")
    # a Han character takes two bytes more than it counts: most texts needn't be looked through for them
    han = (F.octet_length("text") - F.char_length("text") >= 2) & F.col("text").rlike(HAN)
    latin = F.when(han, F.regexp_replace(text, "[㐀-鿿，。、；：！？（）]+", " ")).otherwise(text)
    tokens = F.split(F.replace(latin, F.lit("\n"), F.lit(" ")), " ")
    triples = F.when(han, F.transform(_triples(F.col("text")), lambda x: F.concat(F.lit(MARK), x))).otherwise(F.array().cast("array<string>"))
    return clean.select(F.explode(F.concat(tokens, triples)).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def _lexicon(counted: DataFrame) -> DataFrame:
    """Words of clean text with their counts: ``word`` (lower case), ``n``."""
    words = counted.where(~F.col("token").startswith(MARK)).select(F.explode(F.regexp_extract_all("token", F.lit(WORD), F.lit(0))).alias("word"), "n")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


HAN, MARK = "[㐀-鿿]", "\x01"


def _han_pairs() -> list[tuple[str, str]]:
    return [(a, b) for x in HAN_LOOKALIKES.split() for a, b in (x, x[::-1])]


def _triples(text: Column) -> Column:
    """Han characters that have look-alikes, each with the characters on both sides."""
    either = "".join(sorted({a for a, _ in _han_pairs()}))
    return F.regexp_extract_all(text, F.lit(f"(?=([^\\n][{either}][^\\n]))"), F.lit(1))


def _layout(scanned: DataFrame) -> DataFrame:
    """Lines with what their place on the page says: ``id``, ``line_no``, ``body``, ``indented``, ``noise`` (header, page_number or null), ``marks`` (evidence of pages in the record)."""
    lines = scanned.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = lines.select("id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "raw", F.regexp_replace("raw", rf"^[{BLANKS}]+|[{BLANKS}]+$", "").alias("body"))
    order, record = Window.partitionBy("id").orderBy("line_no"), Window.partitionBy("id")
    whole = record.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    roman = r"(?i)^[ivxlc]{1,7}$"
    number = r"(?i)^(?:(?:page|seite|página|pagina|pág\.?|pag\.?|p\.|s\.|第)\s*)?[-—–\[(|]?\s*([0-9]{1,4}|[ivxlc]{1,7})\s*[-—–\])|]?\s*(?:页|(?:of|von|de|sur|/)\s*[0-9]{1,4})?$"
    lines = (
        lines.withColumn("ff", F.col("raw").contains("\f"))
        .withColumn("n", F.char_length("body"))
        .withColumn("number", F.when(F.col("n") > 0, F.regexp_extract("body", number, 1)))
        .withColumn("plain", F.col("body").rlike(r"^[0-9]{1,4}$") & ~F.col("raw").rlike(r"^\f? {2,}"))
        .withColumn("title", ~F.col("body").rlike(r"[.!?。！？,;]$|^\p{Ll}|^$"))
        .withColumn("key", F.when(F.col("title"), F.regexp_replace(skeleton(F.regexp_replace("body", r"[0-9]{2,}|^[0-9]+\s|\s[0-9]+$", " ")), r"[^\p{L}…]+", "")))
    )
    lines = lines.withColumn("indented", F.col("raw").rlike(r"^\f?(?: {2,}|\t|　)")).drop("raw")
    lines = lines.withColumn("number", F.when(F.col("number") != "", F.col("number"))).withColumn("value", F.when(~F.col("number").rlike(roman), F.col("number").cast("int")))
    near = lambda c, k: F.lag(c, k).over(order) if k > 0 else F.lead(c, -k).over(order)
    lines = lines.withColumns({
        "first": F.min(F.when(F.col("n") > 0, F.col("line_no"))).over(record),
        "last": F.max(F.when(F.col("n") > 0, F.col("line_no"))).over(record),
        "alike": F.count("*").over(Window.partitionBy("id", "key")),
        "in_block": F.coalesce(near("plain", 1), F.lit(False)) | F.coalesce(near("plain", -1), F.lit(False)),
        "next_ff": F.coalesce(near("ff", -1), F.lit(False)),
    })
    twice = F.col("number").isNull() & F.coalesce(F.char_length("key") >= 4, F.lit(False)) & (F.col("alike") > 1)
    lines = lines.withColumn("twice", twice).withColumn("width", F.max(F.when(F.col("number").isNull() & ~F.col("twice"), F.col("n"))).over(record))
    # a line of the text leaves no room for the next line's first word
    held = F.when((F.col("n") > 0) & F.col("number").isNull() & ~F.col("twice"), F.col("body"))
    # no more than a few blank lines, numbers and headers stand between two lines of the text
    lines = lines.withColumn("after", F.first(held, ignorenulls=True).over(order.rowsBetween(1, 12)))
    word = F.least(F.char_length(F.regexp_extract("after", r"^(?:[㐀-鿿]|\S+)", 0)), F.lit(20))
    lines = lines.withColumn("unfilled", F.when(F.col("after").isNull(), F.col("n") <= 0.85 * F.col("width")).otherwise(F.col("n") + 1 + word <= F.col("width")))
    edge = F.col("ff") | F.col("next_ff") | (F.col("line_no") == F.col("first")) | (F.col("line_no") == F.col("last"))
    lines = lines.withColumn("repeated", F.col("twice") & (F.coalesce("unfilled", F.lit(True)) | edge | (F.col("alike") > 2)))
    single = F.col("plain") & ~F.col("in_block")
    values = F.collect_list(F.when(single, F.struct("line_no", "value"))).over(whole)
    lines = lines.withColumn("values", F.when(single, values))
    counted = F.exists("values", lambda v: (F.abs(v["value"] - F.col("value")) == 1) & ((v["line_no"] > F.col("line_no")) == (v["value"] > F.col("value"))) & (F.abs(v["line_no"] - F.col("line_no")) >= 8))
    # a line that stands once must begin or end as the headers of several records do
    bare = F.when(F.col("title") & (F.col("repeated") | F.col("unfilled")), skeleton(F.regexp_replace("body", r"[0-9|]+|[-–] rev.*$", " ")))
    lines = lines.withColumn("opens", F.regexp_extract(bare, r"^\W*([㐀-鿿]|\w+)", 1)).withColumn("closes", F.regexp_extract(bare, r"([㐀-鿿]{1,2}|\w+)\W*$", 1))
    lines = materialize(lines.drop("key", "alike", "twice", "title"), "layout")
    beside = F.coalesce(near("repeated", 1), F.lit(False)) | F.coalesce(near("repeated", -1), F.lit(False))
    is_number = F.col("number").isNotNull() & F.when(F.col("plain"), single & (edge | beside | F.coalesce(counted, F.lit(False)))).otherwise(True)
    lines = lines.withColumn("is_number", F.coalesce(is_number, F.lit(False)))
    beside = F.coalesce(near("is_number", 1), F.lit(False)) | F.coalesce(near("is_number", -1), F.lit(False))
    before = F.last(F.when((F.col("n") > 0) & ~F.col("is_number"), F.col("body")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    open_end = ~F.col("body").rlike(r"[.!?:;,。！？；，：、]$")
    short = (F.col("n") > 0) & F.col("unfilled") & open_end & F.col("number").isNull() & ~F.col("body").rlike(r"^\p{Ll}|^[0-9](?![0-9]*  )|[-‐\u00AD¬]$")
    broken = before.rlike(r"[\p{L}\p{N},\-‐\u00AD¬]$") & F.col("after").rlike(r"^\p{Ll}")
    lines = lines.withColumn("lone", short & (edge | beside | F.coalesce(broken, F.lit(False))))
    headers = lines.where("repeated").select("id", "opens", "closes")
    often = lambda c: headers.groupBy(c).agg(F.countDistinct("id").alias("records")).where("records >= 2").select(F.col(c).alias(f"known_{c}"))
    # most lines have neither word; a key of their record spreads them over the tasks
    spread = lambda c: F.coalesce(F.col(c), F.concat(F.lit(MARK), "id"))
    lines = lines.join(often("opens"), spread("opens") == F.col("known_opens"), "left").join(often("closes"), spread("closes") == F.col("known_closes"), "left")
    lines = lines.withColumn("lone", F.col("lone") & (F.col("known_opens").isNotNull() | F.col("known_closes").isNotNull() | F.col("body").endswith("…")))
    lines = lines.withColumn("marks", F.max(F.col("ff") | F.col("is_number") | F.col("repeated")).over(record))
    header = (F.col("repeated") | F.col("lone")) & (F.col("marks") | F.col("body").rlike(r"  (?:\|  )?[0-9]+$|^[0-9]+  "))
    noise = F.when(F.col("is_number"), "page_number").when(header, "header")
    return lines.select("id", "line_no", "body", "indented", noise.alias("noise"), "marks")


def _words(lines: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(breaks, words). breaks: ``id``, ``line_no`` of lines that end within a word; words: ``id``, ``line_no``, ``next_no``, ``place``, ``before``, ``word``, ``at`` (how much of a broken word stands in the first line)."""
    body = lines.where("noise is null and body <> ''")
    order = Window.partitionBy("id").orderBy("line_no")
    flow = body.withColumn("next_body", F.lead("body").over(order)).withColumn("next_no", F.lead("line_no").over(order))
    left = F.regexp_extract("body", r"([\p{L}\p{N}|$'’-]*[\p{L}0-9|$])[-‐\u00AD¬]$", 1)
    right = F.regexp_extract("next_body", r"^([\p{Ll}0-9|$][\p{L}0-9|$'’-]*)", 1)
    flow = flow.withColumns({"left": left, "right": F.coalesce(right, F.lit("")), "soft": F.col("body").rlike(r"[‐\u00AD¬]$")})
    broken = (F.col("left") != "") & (F.col("right") != "") & F.col("left").rlike(r"\p{L}") & F.col("right").rlike(r"\p{L}")
    flow = materialize(flow.withColumn("broken", broken), "flow")
    ends = flow.where("broken").select("id", "line_no", "next_no", "left", "right", "soft", F.concat("left", "right").alias("joined"), F.concat_ws("-", "left", "right").alias("hyphened"))
    forms = lexicon.groupBy(skeleton(F.col("word")).alias("skeleton")).agg(F.sum("n").alias("n"))
    whole = forms.select(F.col("skeleton").alias("s1"), F.col("n").alias("as_joined"))
    parts = forms.select(F.col("skeleton").alias("s2"), F.col("n").alias("as_hyphened"))
    ends = ends.withColumn("s1", skeleton(F.col("joined"))).withColumn("s2", skeleton(F.col("hyphened"))).join(whole, "s1", "left").join(parts, "s2", "left")
    natural = ~F.col("soft") & F.col("as_hyphened").isNotNull() & (F.coalesce("as_joined", F.lit(0)) * RATIO < F.col("as_hyphened"))
    ends = materialize(ends.withColumn("natural", natural), "ends")
    # where the text ends there, a soft mark breaks a word, and so does any after what isn't a word
    torn = flow.where("not broken and left <> '' and next_body is null").withColumn("word", F.lower("left"))
    torn = torn.join(lexicon.where("n > 2").select("word", "n"), "word", "left").where("(soft or n is null) and left rlike '^[\\\\p{L}0-9|$]+$' and left rlike '\\\\p{Ll}'")
    # the words of each line without a broken word's parts, then the broken words themselves
    cut = F.regexp_replace("body", F.when(F.col("broken"), F.lit(r"[\p{L}\p{N}|$'’-]+[-‐\u00AD¬]$")).otherwise(F.lit(r"$^")), " ")
    headless = F.when(F.lag("broken").over(order), F.regexp_replace(cut, r"^[\p{L}0-9|$'’-]+", " ")).otherwise(cut)
    own = flow.select("id", "line_no", F.regexp_extract_all(headless, F.lit(WORD), F.lit(0)).alias("tokens"))
    each = F.transform("tokens", lambda w, k: F.struct(F.lower(F.get("tokens", k - 1)).alias("before"), w.alias("word")))
    inner = own.select("id", "line_no", F.explode(each).alias("w"))
    inner = inner.select("id", "line_no", F.lit(None).cast("bigint").alias("next_no"), "w.before", "w.word", F.lit(None).cast("int").alias("at"))
    across = ends.select("id", "line_no", "next_no", F.lit(None).cast("string").alias("before"), F.when(F.col("natural"), F.col("hyphened")).otherwise(F.col("joined")).alias("word"), (F.char_length("left") + F.col("natural").cast("int")).alias("at"))
    breaks = ends.where("not natural").select("id", "line_no").unionByName(torn.select("id", "line_no"))
    return breaks, inner.unionByName(across)


def _misread(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words of scanned lines that clean text doesn't know as they are, with the form it knows: ``word``, ``form``, ``n``; a row per possible form."""
    seen = words.where(~F.col("word").rlike(HAN) & F.col("word").rlike(r"\p{L}.*[\p{L}\p{N}|$]|[\p{N}|$].*\p{L}")).select(F.lower("word").alias("word")).distinct()
    counted = seen.join(lexicon.select("word", F.col("n").alias("own")), "word", "left").withColumn("s", _skeletons(F.col("word")))
    forms = lexicon.where("n > 2").select(_skeletons(F.col("word")).alias("s"), F.col("word").alias("form"), "n")
    met = counted.join(forms, "s").where((F.col("form") != F.col("word")) & (F.coalesce("own", F.lit(0)) * RATIO < F.col("n")))
    met = met.where(F.char_length("word") > 2).select("word", "form", "n").distinct()
    # forms so much rarer than the best one of the word aren't what is meant, whatever stands before it
    return met.withColumn("best", F.max("n").over(Window.partitionBy("word"))).where(F.col("n") * RATIO >= F.col("best")).drop("best")


def _misread_han(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Lines with a Han character between neighbours that clean text never has around it but has around its look-alike: ``id``, ``line_no``, ``triple``, ``other``."""
    order = Window.partitionBy("id").orderBy("line_no")
    body = lines.where("noise is null and body <> ''")
    around = F.concat(F.coalesce(F.right(F.lag("body").over(order), F.lit(1)), F.lit("")), "body", F.coalesce(F.left(F.lead("body").over(order), F.lit(1)), F.lit("")))
    met = body.select("id", "line_no", around.alias("text")).where(F.col("text").rlike(HAN)).select("id", "line_no", F.explode(_triples(F.col("text"))).alias("triple"))
    like: dict[str, list[str]] = {}
    for one, other in _han_pairs():
        like.setdefault(one, []).append(other)
    others = F.create_map(*[x for k, v in like.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    met = met.join(known.select("triple", F.col("n").alias("own")), "triple", "left").withColumn("like", F.explode(others[F.substr("triple", F.lit(2), F.lit(1))]))
    met = met.withColumn("other", F.concat(F.substr("triple", F.lit(1), F.lit(1)), "like", F.substr("triple", F.lit(3), F.lit(1))))
    return met.join(known.select(F.col("triple").alias("other"), "n"), "other").where(F.coalesce("own", F.lit(0)) * RATIO < F.col("n")).where("n > 2").groupBy("id", "line_no", "triple").agg(F.max_by("other", "n").alias("other"))


#: Digits or foreign letters within a word of small letters are misread whether or not the word is known.
FOREIGN = "αοеаосрѕτενﬁﬂ"
MIXED = r"^(?=.*\p{Ll}{2})(?!.*-)(?:.*\p{Ll}[0-9|$].*|.*[0-9|$]\p{Ll}{2}.*)$|^(?=.*[a-z]).*[" + FOREIGN + r"].*$|^[A-Z0-9]*[$|][A-Z]*-[0-9$]+$|^(?=.{2}-)(?:[A-Z][0-9]|[0-9][A-Z])-[0-9]{2,4}$"
ORDINAL = r"(?i)^[0-9]+(?:st|nd|rd|th|er|re|ème|e|º|ª|km|kg|mm|cm|ms|mb|gb|x|h|min|am|pm|s)$"


def _chosen(words: DataFrame, lexicon: DataFrame, clean: DataFrame) -> DataFrame:
    """The wrong words of the lines with the form meant: ``id``, ``line_no``, ``next_no``, ``at``, ``lower``, ``form``.

    Where a word may stand for several forms, the one that stands most often after the same word in clean text and all
    scanned lines is meant, then the most frequent one.
    """
    forms = materialize(_misread(words, lexicon), "forms")
    several = forms.groupBy("word").agg(F.count("*").alias("k")).where("k > 1").select("word")
    if several.isEmpty():  # nothing to choose: the text needn't be read once more
        low = words.withColumn("lower", F.lower("word")).join(forms.withColumnRenamed("word", "lower"), "lower")
        return low.select("id", "line_no", "next_no", "at", "lower", "before", "form")
    asked = materialize(forms.join(several, "word", "left_semi").select("form").distinct(), "asked")
    # a list of words that fits every task stays where the text is; a longer one meets it on the word
    listed_forms = F.broadcast(asked) if asked.count() <= MOST_FORMS else asked
    listed = clean.select(F.explode(F.array(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("tokens"))  # a row as it was, but the words are found once
    pairs = listed.select(F.explode(F.transform("tokens", lambda w, k: F.struct(F.get("tokens", k - 1).alias("before"), w.alias("form")))).alias("p")).select("p.*")
    pairs = pairs.unionByName(words.select("before", F.lower("word").alias("form")))
    follow = pairs.join(listed_forms, "form", "left_semi").groupBy("before", "form").agg(F.count("*").alias("together"))
    low = words.withColumn("lower", F.lower("word")).join(forms.withColumnRenamed("word", "lower"), "lower").join(follow, ["before", "form"], "left")
    best = F.max_by("form", F.struct(F.coalesce("together", F.lit(0)), "n", "form")).alias("form")
    return low.groupBy("id", "line_no", "next_no", "at", "lower", "before").agg(best)


class _Pages:
    """The steps that finding noise and repairing text have in common."""

    def __init__(self, records: DataFrame, config: DataFrame) -> None:
        known = _records(records, config)
        clean = known.where("not filled")
        counted = materialize(_counted(clean), "counted")
        self.lexicon = materialize(_lexicon(counted), "lexicon")
        self.triples = counted.where(F.col("token").startswith(MARK)).select(F.substr("token", F.lit(2)).alias("triple"), "n")
        self.lines = materialize(_layout(known.where("filled").groupBy("id").agg(F.max("text").alias("text"))), "lines")
        self.breaks, words = _words(self.lines, self.lexicon)
        self.words = materialize(words, "words")
        self.wrong = _chosen(self.words, self.lexicon, clean)


def find_noise(records: DataFrame, config: DataFrame) -> DataFrame:
    """Noise in the lines of scanned records: ``id``, ``line_no``, ``noise_kind`` (header, page_number, hyphen, misread).

    Records of sources whose ``pdf_parse_mode`` is text, null texts, and texts whose lines aren't filled have no noise.
    An id delivered twice counts once. Lines are those between line feeds, counted from 1.
    """
    pages = _Pages(records, config)
    lines, hyphens = pages.lines, pages.breaks
    low, known_wrong = pages.words, pages.wrong
    same = F.aggregate(F.sequence(F.lit(1), F.least(F.char_length("lower"), F.char_length("form"))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substr(F.col("lower"), i, F.lit(1)) == F.substr(F.col("form"), i, F.lit(1))), i).otherwise(k))
    spot = known_wrong.select("id", F.when(F.col("at").isNull() | (same < F.col("at")), F.col("line_no")).otherwise(F.col("next_no")).alias("line_no"))
    mixed = low.where(F.col("word").rlike(f"[0-9|${FOREIGN}]") & F.col("word").rlike(MIXED) & ~F.col("word").rlike(ORDINAL)).select("id", "line_no")
    misread = spot.unionByName(mixed).unionByName(_misread_han(lines, pages.triples).select("id", "line_no")).distinct().withColumn("noise_kind", F.lit("misread"))
    layout = lines.where("noise is not null").select("id", "line_no", F.col("noise").alias("noise_kind"))
    broken = hyphens.select("id", "line_no").distinct().withColumn("noise_kind", F.lit("hyphen"))
    return layout.unionByName(broken).unionByName(misread)


def repair(records: DataFrame, config: DataFrame) -> DataFrame:
    """The text of scanned records as continuous paragraphs: ``id``, ``para_no`` (from 1), ``paragraph``.

    Headers and page numbers go, broken words are joined, misread words give way to the form meant, and lines follow each
    other until a blank line or an indent. Blank lines around a page's edge end no paragraph whose sentence goes on.
    Records as in :func:`find_noise`; those without any noise come out with their lines joined.
    """
    pages = _Pages(records, config)
    order = Window.partitionBy("id").orderBy("line_no")
    lines = pages.lines.join(pages.breaks.select("id", "line_no", F.lit(True).alias("breaks")).distinct(), ["id", "line_no"], "left")
    # whether only blanks and noise stand between a line and the one before, and which of them
    kept = (F.col("body") != "") & F.col("noise").isNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(order)
    lines = lines.withColumns({"blanks": count(F.col("body") == ""), "noises": count(F.col("noise").isNotNull())}).where(kept)
    last = lambda c: F.lag(c).over(order)
    blank = F.col("blanks") > F.coalesce(last("blanks"), F.lit(0))
    edge = F.col("noises") > F.coalesce(last("noises"), F.lit(0))
    ended = last("body").rlike(r"[.!?:…。！？][\"”’»)]*$")
    starts = last("body").isNull() | (blank & (~edge | ended)) | (F.col("indented") & ended)
    lines = lines.withColumn("starts", F.coalesce(starts, F.lit(True))).withColumn("para_no", count(F.col("starts")).cast("bigint"))
    torn = F.coalesce("breaks", F.lit(False))
    glued = F.when(torn, F.regexp_replace("body", r"[-‐\u00AD¬]$", "")).when(F.col("body").rlike(r"\p{L}-$|[㐀-鿿]"), F.col("body")).otherwise(F.concat("body", F.lit(" ")))
    paragraphs = lines.groupBy("id", "para_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", glued.alias("part")))), lambda x: x["part"]), "").alias("joined"))
    # a record's wrong words are as many as its lines at most have
    meant = pages.wrong.select("id", "lower", "form").groupBy("id", "lower").agg(F.max("form").alias("form")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("lower", "form"))).alias("meant"))
    han = _misread_han(pages.lines, pages.triples).groupBy("id").agg(F.collect_set(F.struct("triple", "other")).alias("han"))
    paragraphs = paragraphs.join(han, "id", "left")
    restored = F.aggregate("han", F.col("joined"), lambda text, x: F.replace(text, x["triple"], x["other"]))
    paragraphs = paragraphs.withColumn("joined", F.coalesce(restored, "joined"))
    chunks = F.split(F.trim("joined"), " ")
    core = lambda w: F.regexp_extract(w, WORD, 0)
    found = lambda w: F.element_at("meant", F.lower(core(w)))
    cased = lambda w: F.when(core(w).rlike(r"^\p{Lu}"), F.concat(F.upper(F.left(found(w), F.lit(1))), F.substr(found(w), F.lit(2)))).otherwise(found(w))
    fixed = F.transform(chunks, lambda w: F.when(F.col("meant").isNotNull() & (core(w) != "") & found(w).isNotNull(), F.replace(w, core(w), cased(w))).otherwise(w))
    return paragraphs.join(meant, "id", "left").select("id", "para_no", F.array_join(fixed, " ").alias("paragraph"))
