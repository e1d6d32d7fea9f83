r"""Line-first quality rules.

Each line of a text is judged by itself: punctuation (it has to end like a sentence of its script, without runs of
exclamation marks or words that carry symbols), navigation (separators, or a few words without an end), boilerplate (set
phrases of sites, in English, German, French and Spanish only; lines that a site repeats in other languages go by their
missing end, or stay: what repeats across documents is left to the dedup operators).
Repeats of a line count once. Failing lines are removed, and a document goes if that takes too many of its words. Base
rules on length and on repeated three-word windows come first.

All of it runs as column expressions in one pass over the rows: no shuffle, no Python. Windows are first compared by
64-bit hashes; only texts that have equal hashes are compared by their words, so results are exact.

Defined results: null text has no words and fails; lines without a word are dropped from the cleaned text; repeated rows
each get their own result; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import SPACES, WORD, words

#: Marks that end a sentence, by script. Latin, Greek and Cyrillic; Chinese and Japanese; Arabic and Urdu;
#: Hindi and other scripts of India; Armenian; Ethiopic; Khmer; Burmese; Tibetan; Mongolian; doubled ones. Thai and Lao
#: have none.
MARKS = ".!?:;…" + "。！？；：．｡" + "؟؛۔" + "।॥" + "։" + "።፧፨" + "។៕" + "။" + "།༎" + "᠃" + "‽⁇⁈⁉"
#: What may close a quotation or bracket behind them. Fixed values.
CLOSING = "\"'”’“‘»«›‹)" + "」』）】》〉〕］｝"
#: The last character of a line that ends like a sentence.
ENDS = MARKS + CLOSING + "]"
#: Letters of scripts that put no spaces between words; two of them count as a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
#: A symbol, or two exclamation marks.
NOISE = r"[#*$%&|<>]|!!"
#: A word that carries a symbol, or ends in two exclamation marks.
NOISE_WORD = r"[^\x20\x09-\x0D]*(?:[#*$%&|<>]|!!)[^\x20\x09-\x0D]*"
#: Site phrases that make a short line boilerplate, in English, German, French and Spanish. Fixed values; any case.
PHRASES = "|".join(
    (
        r"all rights reserved|cookies? (?:policy|settings)|we use cookies|enable javascript|privacy policy|terms of (?:use|service)",
        r"sign (?:in|up)\b|log ?in\b|subscribe (?:now|to)|click here|share (?:this|on)|skip to (?:main )?content|back to top",
        r"alle rechte vorbehalten|cookie-(?:einstellungen|richtlinie)|wir verwenden cookies|datenschutzerklärung|nutzungsbedingungen",
        r"jetzt (?:anmelden|abonnieren|registrieren)|hier klicken|zum inhalt springen|nach oben scrollen|javascript aktivieren",
        r"tous droits réservés|politique de confidentialité|conditions d.utilisation|nous utilisons des cookies|gérer les cookies",
        r"se connecter\b|abonnez-vous|cliquez ici|aller au contenu|retour en haut|activer javascript",
        r"todos los derechos reservados|política de (?:privacidad|cookies)|términos (?:de uso|y condiciones)|utilizamos cookies",
        r"iniciar sesión|suscríbete|haga clic aquí|saltar al contenido|volver arriba|activar javascript",
    )
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def half_words(line: Column, n: Column) -> Column:
    """Twice the number of words n of a line, for scripts without spaces counted from their letters: in a line of which a
    quarter is such letters (they take three bytes), each adds a half word."""
    return n * 2 + F.when((F.octet_length(line) - F.length(line)) * 2 > F.length(line), _count(line, UNSPACED)).otherwise(F.lit(0))


def line_passes(line: Column, n: Column, halves: Column, noise_pct: int = 20, short_words: int = 3, phrase_words: int = 30) -> Column:
    """Whether a line of n words (and `halves` half words) stays. noise_pct: share of words with symbols from which it goes;
    short_words: lines of up to four times so many words need a sentence's end; phrase_words: only lines up to that length
    go for a phrase. In lines of scripts without spaces symbols are counted themselves, not the words that carry them."""
    # Most lines have no symbol at all, which is quick to see.
    noise = F.when(line.rlike(NOISE), F.when(halves > n * 2, _count(line, NOISE)).otherwise(_count(line, NOISE_WORD))).otherwise(F.lit(0))
    # One look at the last character: a pattern would try a class of many characters at every place of the line.
    punctuation = (halves > short_words * 8) | F.contains(F.lit(ENDS), F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1)))
    navigation = _count(line, r"[|»›•]") * 10 > halves
    boilerplate = (halves <= phrase_words * 2) & line.rlike(f"(?iu)(?:{PHRASES})")
    return punctuation & (noise * 200 < halves * noise_pct) & ~navigation & ~boilerplate


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50, max_loss_pct: int = 50, carry: Column | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_words, clean_text, kept."""
    more = [] if carry is None else ["carried"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), words(F.col(text_col)).alias("w"), *([] if carry is None else [carry.alias("carried")]))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    # Columns of one step are used more than once in the next, which keeps Spark from merging the steps.
    d = d.select("*", F.size("w").cast("long").alias("n_words"), F.when(F.size("w") >= 3, hashes).otherwise(F.array().cast("array<bigint>")).alias("h"), lines.alias("lines"))
    d = d.select("*", F.array_distinct("lines").alias("own"), (F.size(F.array_distinct("h")) < F.size("h")).alias("again"))
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("g"), i.alias("i"))))
    counted = F.transform("own", lambda x: F.struct(x.alias("line"), _count(x, WORD).alias("n")))
    counted = F.transform(counted, lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), half_words(x["line"], x["n"]).alias("halves")))
    good = F.transform(F.filter(counted, lambda x: line_passes(x["line"], x["n"], x["halves"])), lambda x: x["line"])
    d = d.select("*", F.when(F.col("again"), windows).alias("s"), good.alias("good"))
    same = F.filter("s", lambda x, k: (F.get("s", k - 1)["g"] == x["g"]) | (F.get("s", k + 1)["g"] == x["g"]))
    d = d.select("*", F.sort_array(F.transform(F.when(F.col("again") & (F.size("s") > 0), same), lambda x: x["i"])).alias("p"))
    gaps = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("p") > 0, F.aggregate(gaps, F.lit(3), lambda a, b: a + b)).otherwise(0)
    d = d.select(
        "doc_id",
        "n_words",
        (F.when(F.size("w") > 0, F.length(F.array_join("w", "")))).otherwise(0).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size("own")).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.array_join("good", "\n").alias("clean_text"),
        # Spark never moves a filter below a column like this one. Moved below, a filter would repeat the steps above
        # inside their own loops.
        F.monotonically_increasing_id().alias("row"),
        *more,
    )
    d = d.withColumn("n_repeat_words", F.when(F.col("row") >= 0, F.col("n_repeat_words")))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    d = d.select("*", failed.alias("base_failed"), _count(F.col("clean_text"), WORD).cast("long").alias("clean_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_words", "clean_text", (~F.col("base_failed") & (F.col("clean_words") * 100 >= F.col("n_words") * (100 - max_loss_pct))).alias("kept"), *more)


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules: int) -> DataFrame:
    """The rows that stay, with the columns of df; the text holds the lines that stay."""
    names = [f"c{i}" for i in range(len(df.columns))]
    renamed = df.toDF(*names)
    of = dict(zip(df.columns, names, strict=True))
    kept = measure(renamed, of[id_col], of[text_col], carry=F.struct(*(n for n in names if n != of[text_col])), **rules).filter("kept")
    return kept.select(*(F.col("clean_text" if c == text_col else f"carried.{n}").alias(c) for n, c in zip(names, df.columns, strict=True)))
