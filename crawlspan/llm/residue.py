"""Pages whose title is template residue, filler, an error or block message, or a notice that scripts are needed.

A title is reduced to its core: character references resolved, invisible characters dropped, and the site's name, as its host
spells it, cut off. What decides is evidence that adds up; RESIDUE points make a page residue.

- Placeholder detectors decide alone: signs of template languages and values that were never rendered, wherever they stand,
  unless the words around them speak of notation.
- Mismatch: the core shares no term with the address slug, and less than half of its terms with the body (description, headings
  that don't just repeat the title). 1 point.
- The core has the form of a known message (2 points) or mentions one (1 point); neither is enough alone. On a page with hardly
  any text, or beside a known form with an error status, 1 point more.
- Host evidence, for cores that no form decides: the same core, numbers aside, stands on pages with hardly any text on HOSTS hosts
  and a fifth of its hosts at least (duplicated low information, 2 points), while no term of it names anything in the corpus: none
  is in the slugs of HOSTS hosts, nor do the bodies support it (mismatch, 1 point). This finds messages that no list has.

Each page is examined once; its short columns are written to the shared checkpoint folder and read from there. All but the decoding of
references is columns. The host evidence is aggregated map-side by (core, host), then by core; rows of hot cores stay where they
are (`operators.skew`), and the terms of the few cores that repeat are looked up in the slugs' terms by a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlspan.functions.urls import let
from crawlspan.llm.duplicates import decoded
from crawlspan.operators import skew
from crawlspan.sources.tables import checkpoint_dir

#: Points that make a page residue.
RESIDUE = 3
#: Words of text below which a page has hardly any content.
THIN = 150
#: Host evidence: hosts that share a core, the share of them on which it stands on a thin page, and the longest core in words.
HOSTS = 3
THIN_HOSTS = 0.2
SHORT_CORE = 9

# The notations of template languages, as they look when nothing was filled in.
PLACEHOLDERS = (
    r"\{\{.*?\}\}+", r"\{%.*?%\}", r"<%.*?%>", r"<\?.*?\?>", r"\$\{[^}]*\}", r"#\{[^}]*\}", r"\[\[.*?\]\]", r"%%\w+%%", r"##\w+##", r"@@\w+@@",
    r"__[\p{L}\d]+(_[\p{L}\d]+)*__", r"%[\p{L}_]{3,}%", r"\$[\p{L}_]{3,}\$", r":[\p{L}]+(_[\p{L}]+)+:", r"\{[\p{L}_.]{2,}\}", r"\{\d+\}",
    r"\[[\p{L} _-]*(title|your|name|heading|headline|insert|placeholder|missing|text|here|city|product)[\p{L} _:.-]*\]", r"\[object object\]", r"(?<![\w%])%[sd](?!\w)",
    r"\[(location|town|place|region|country|brand|company|business|keyword|category|author|service)([ _-]name)?\]", r"(?<![\w$])\$\p{L}[\p{L}_.]{2,}(?![\w$])", r"<(?!/|(?:html|head|title|meta|link|body|main|nav|header|footer|section|article|aside|br|hr|em|strong|span|div|sup|sub|small|big|mark|code|pre|font|img|iframe|script|style|form|input|button|table|tr|td|th|ul|ol|li|h[1-6])\b)[\p{L}_.-]{2,}>",
)

# What every one of these forms has.
SIGNS = r"[{<\[%#@$]|__|:\p{L}+_"

# Values that were never rendered.
UNRENDERED = ("undefined", "null", "nan", "none", "nil", "n a")

# Words of headlines about notation; those of TOPICS decide alone, those of NEAR beside a quoted or discussed notation.
TOPICS = r"(?<!\p{L})(printf|placeholders|interpolation|templating|(template|merge|format) (syntax|languages?|engines?|tags?|variables?|strings?|literals?|fields?|values?)|format specifiers?|curly bra(ces|ckets)|regular expressions?)(?!\p{L})"
NEAR = r"(?<!\p{L})(templates?|strings?|syntax|markup|notation|variables?|braces|brackets|escap(e|es|ed|ing)|mustache|handlebars|jinja|liquid|twig|php|sql|java|javascript|typescript|python|ruby|perl|shell|code|coding|programm(ing|ers?)|html|format(s|ting)?|parser|compiler|debugging)(?!\p{L})"
ASKS = r"(?<!\p{L})(what|why|how|when)(?!\p{L})"
SPEAKS = r"(?<!\p{L})(writ(e|es|ing)|us(e|es|ing)|typ(e|es|ing)|print(s|ing)?|pars(e|es|ing)|check(s|ing)? for|means?|meaning of|versus|vs\.?|between|about|avoid(s|ing)?|handl(e|es|ing)|replac(e|es|ing)) (the |an? )?"
QUOTES, DOUBLE = "[\"'“”‘’«»„‚`]", '["“”«»„`]'
# An unrendered value where a name or place would stand; one in the spelling of programs in a title of capitalised words.
SLOT = r"(?:^|[,;|–—:·/(\[-]\s*|(?<!\p{L})(?:in|for|from|of|by|at|to|near|with|and|&) )(undefined|null)\s*(?:$|[,;|–—:·/)\].!-])"
VALUE = r"(?s)(?<![\p{L}\p{N}])NaN(?![\p{L}\p{N}])|^(?=.*\p{Lu})(?=.*(?<![\p{L}\p{N}])(?:undefined|null)(?![\p{L}\p{N}]))(?!.*(?<!\p{L})(?!(?:undefined|null)(?!\p{L}))\p{Ll}{5})"

# Filler and default texts, as words in lower case.
FILLER = (
    r"(.* )?lorem ipsum dolor( .*)?", r"lorem ipsum", r"dolor sit amet( .*)?", r"consectetur adipiscing( .*)?", r"(untitled|unnamed)( (document|page|post))?( \d+)?",
    r"(new|sample|test|example|default|dummy) (page|post|title|document|text)( \d+)?( please ignore)?", r"(page|document|post|site|blog) title", r"hello world",
    r"(todo|tbd|tba|fixme)( \S+){0,2}", r"(insert|enter|add|put|type)( (a|an|the|your|page|site|own))* \S+( \S+)? here", r"your( \S+){1,3}( goes)? here",
    r"(title|headline|heading|text|tagline)( goes)? here", r"(my|just another) wordpress( \S+)?", r"filler (copy|text)( .*)?", r"placeholder( (text|title|page))?",
    r"(.* )?text text text( .*)?", r"(asdf|qwerty|qwertz|foo|bar|baz|blah|bla|test|abc|xyz|text)( (asdf|qwerty|qwertz|foo|bar|baz|blah|bla|test|abc|xyz|text))*", r"x{3,}( x{3,})*", r"(asdf)+(jkl)?",
    r"blindtext( .*)?", r"platzhalter(text)?( .{0,12})?", r"(titel|überschrift)( hier)?( einfügen)?( folgt)?", r"beispiel(seite|titel|text)", r"ohne titel", r"texte (à venir|d exemple|de remplissage)",
    r"titre (de la page|ici|d exemple)", r"page d exemple", r"sans titre", r"(título|texto|página) de (ejemplo|relleno|muestra)", r"título de la página", r"sin título", r"(voorbeeld|opvul)(tekst|titel|pagina)",
    r"titel van de pagina", r"zonder titel", r"no title", r"заголовок страницы", r"без названия", r"無題",
)

# Error pages and block messages.
ERRORS = (
    r"(http )?(error|fehler|erreur|fout|errore|ошибка)( code)? [45]\d\d( \S+){0,4}", r"[45]\d\d( (error|fehler|erreur))?",
    r"(http )?[45]\d\d (error )?(bad request|unauthorized|forbidden|(page )?not found|method not allowed|request timeout|conflict|gone|too many requests|(internal )?server error|bad gateway|service (temporarily )?unavailable|gateway time ?out)",
    r"((oops|sorry|whoops|ups) )*we (couldn.?t|could not|can.?t|cannot) find (that|this|the) (page|address|url)( .{0,30})?",
    r"((oops|sorry|whoops|ups) )*((that|this|the) )?(requested )?(page|url|document|resource|file|content)( you (requested|are looking for))? (was not|wasn.?t|can.?t be|cannot be|could not be|couldn.?t be|is not|isn.?t|does not|doesn.?t|not|no longer) (found|available|exists?)( .{0,20})?",
    r"not found", r"(die )?seite (wurde )?nicht gefunden", r"(cette )?page (introuvable|non trouvée)", r"página no encontrada", r"pagina (niet gevonden|non trovata)", r"страница не найдена", r"ページが見つかりません(でした)?",
    r"(access|permission) denied", r"forbidden", r"unauthorized", r"zugriff verweigert", r"accès (refusé|interdit)", r"acceso denegado", r"toegang geweigerd", r"доступ запрещ[её]н",
    r"(internal )?server error", r"bad gateway", r"gateway time ?out", r"service (temporarily )?unavailable", r"interner serverfehler", r"erreur interne du serveur", r"error interno del servidor",
    r"(this |the |your )?account (has been |is )?suspended", r"((this |the )?(site|website|shop|store|page) )?(is )?((currently|temporarily) )?(under|in|down for) (maintenance|construction)( .{0,20})?", r"wartungsarbeiten",
    r"(this|the) (site|website|shop|store|page|product) is (currently |temporarily )?(not available|unavailable|offline|closed)", r"error establishing a database connection", r"database (connection )?error",
    r"((oops|sorry) )*(something went wrong|an (unexpected )?error (has )?occurred)( .{0,20})?", r"(etwas ist schiefgelaufen|une erreur est survenue|algo salió mal|er is iets misgegaan)",
    r"(the )?(request|connection|page|gateway) (has )?timed out", r"zeitüberschreitung( .{0,20})?", r"(your |the )?session (has )?(expired|timed out)", r"(ihre )?sitzung (ist )?abgelaufen", r"(votre )?session (a )?expirée?", r"(su )?sesión (ha )?(expirado|caducado)",
    r"(php )?(fatal|parse|syntax) error .*", r"(php )?(warning|notice|deprecated) .*(undefined|on line|array|index|offset|expects|failed|deprecated).*", r"(unhandled|uncaught) .*", r"traceback .*", r".* on line \d+",
    r"nothing (was )?(found )?here( \S+)?", r"upstream \S+( .{0,20})?", r"cannot (get|post|put|head|delete)( .*)?", r"(the |this )?(object|page|item|record|resource|article|product|entry|post|node)( \S{1,12})? (does not|doesn'?t|no longer) exists?( .*)?",
    r"(la |cette )?page( \S{1,12})? n'existe (plus|pas)( .*)?", r"unknown (column|table|database|error|host)( .*)?", r"exception in .*", r"no (route|handler|such (file|page|resource))( .*)?",
    r"(sorry )?you have been blocked", r"too many requests", r"rate limit exceeded", r"request blocked",
)

# Notices that scripts, cookies or a check of the browser are needed.
NOTICES = (
    r"(please |you need to |you must |you have to )?(enable|activate|allow|turn on) (javascript|scripts|cookies)( and (javascript|cookies))?( (to|in|for) .*)?", r"javascript( (is|must be|has to be|not))+ (required|needed|disabled|enabled|off|turned off|available|supported)( .*)?", r"javascript required",
    r"(this|the) (site|page|app|website|store|shop|application) (needs|requires|will not work without|won.?t work without|doesn.?t work without|does not work without) (javascript|scripts?)( .*)?", r"your browser (does not|doesn.?t) support (javascript|scripts?|cookies)( .*)?",
    r"(bitte )?aktivieren sie (bitte )?(javascript|skripte)( .*)?", r"(bitte )?javascript (ist |bitte )?(deaktiviert|erforderlich|nicht aktiviert|aktivieren|einschalten|ausgeschaltet)( .*)?",
    r"(veuillez )?(activez|activer|autorisez) javascript( .*)?", r"javascript est (désactivé|requis|nécessaire|obligatoire)( .*)?", r"(por favor )?(habilite|habilita|active|activa) javascript( .*)?", r"javascript (está|es) (desactivado|deshabilitado|necesario|obligatorio)( .*)?",
    r"(schakel|zet) javascript (in|aan)( .*)?", r"javascript (is|staat) (uitgeschakeld|vereist|uit|nodig)( .*)?", r"(пожалуйста )?включите javascript( .*)?", r"javascript\s?を有効にしてください.*", r"ενεργοποιήστε (τη|την|το) javascript( .*)?",
    r"(just a|one) moment( please)?", r"please wait( .*)?", r"attention required( .{0,20})?", r"(checking|verifying) your browser( .*)?", r"(verify|verifying|confirm|checking)( that| if)? you( a|.)?re( a)? human( .*)?", r"are you (a )?(human|robot)", r"(performing )?(a )?security (check|verification)( .{0,20})?", r"ddos protection( .*)?",
)

# Words that such messages mention; on thin pages they decide.
MENTIONS = (
    r"\b(not found|nicht gefunden|introuvable|no encontrad[ao]|niet gevonden|denied|verweigert|forbidden|unavailable|nicht verfügbar|javascript|maintenance|timed out|timeout|expired|abgelaufen|suspended|server error|bad gateway|database|"
    r"verifying|human|captcha|lorem|ipsum|placeholder|untitled|sample page|test page|dummy|error|fehler|erreur|blocked|template|undefined|warning|exception)\b"
)


def whole(patterns: tuple[str, ...]) -> str:
    return "^(" + "|".join(f"(?:{p})" for p in patterns) + ")$"


def site_words(url: Column) -> Column:
    """The site's name as its host spells it: the first label, with blanks for hyphens."""
    return F.translate(F.regexp_extract(F.lower(url), r"^[a-z]+://(?:www\.)?([^/:.?#]+)", 1), "-", " ")


def slug_terms(url: Column) -> Column:
    """Words of three letters and more in the last segment of the path."""
    last = F.regexp_extract(F.lower(url), r"^[a-z]+://[^/?#]+(?:/[^?#]*)?/([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.filter(F.split(last, r"[^\p{L}]+"), lambda w: F.length(w) >= 3)


def core_of(title: Column, url: Column) -> Column:
    """Title in lower case without references, invisible characters, and the site's name at its end or start."""
    plain = F.coalesce(decoded(F.when(title.contains("&"), title)), title)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), r"[\p{Cf}\p{Cc}&&[^\s]]", ""), r"[\s\p{Z}]+", " "))
    site = site_words(url)
    cut = F.regexp_replace(plain, r"[\"'”’)\]*.!\s]+$", "")
    named = F.length(site) >= 3
    last = named & cut.endswith(site) & (F.length(cut) > F.length(site))
    plain = F.when(last, F.regexp_replace(F.substring(cut, F.lit(1), F.length(cut) - F.length(site)), r"\s*[\-–—|·:]?\s*$", "")).otherwise(plain)
    rest = F.substring(plain, F.length(site) + 1, F.length(plain))
    return F.when(named & plain.startswith(site) & rest.rlike(r"^\s*[\-–—|·:]"), F.regexp_replace(rest, r"^\s*[\-–—|·:]\s*", "")).otherwise(plain)


def words_of(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}'’]+", " "))


def body_terms(title: Column, texts: list[Column]) -> Column:
    """Words of three letters and more of the body's texts, without those that only repeat the title or its beginning."""
    plain = lambda x: words_of(F.lower(x))
    said = let(plain(title), lambda low: F.filter(F.transform(F.concat(*texts), plain), lambda x: x.isNotNull() & (x != "") & ~F.startswith(F.coalesce(low, F.lit("")), x)))
    return F.array_distinct(F.regexp_extract_all(F.array_join(said, " "), F.lit(r"\p{L}{3,}"), F.lit(0)))


def examined(pages: DataFrame, *, id: str, title: str, url: str, words: str, status: str, description: str | None = None, headings: str | None = None) -> DataFrame:
    """(_id, terms, _site, reason, points, ...): every page with a title of letters, digits or placeholder signs, and what speaks against it.

    reason is the strongest form that the core has: `placeholder`, `unrendered` (which decide alone), `filler`, `error`,
    `notice`, `message` (a mention), or null.
    """
    texts = ([F.array(F.col(description))] if description else []) + ([F.coalesce(F.col(headings), F.array().cast("array<string>"))] if headings else [])
    body = body_terms(F.col(title), texts) if texts else F.array().cast("array<string>")
    rows = pages.select(
        F.col(id).alias("_id"), F.col(words).alias("_words"), F.coalesce(F.col(status) >= 400, F.lit(False)).alias("_failed"), site_words(F.col(url)).alias("_site"), slug_terms(F.col(url)).alias("_slug"), F.col(title).alias("_raw"),
        core_of(F.col(title), F.col(url)).alias("core"), body.alias("_body"),
    )
    rows = rows.filter(F.col("core").rlike(r"[\p{L}\p{N}]|%s")).withColumn("terms", words_of(F.col("core")))
    marks = "(" + "|".join(PLACEHOLDERS) + ")"
    marked = F.col("core").rlike(SIGNS) & F.col("core").rlike(marks)
    bits = F.split("terms", " ")
    many = F.size(bits)
    bare = F.regexp_replace("terms", "[’]", "'")
    # One pattern for each text, as each is compiled into every filter. What may be notation becomes U+0001.
    noted = F.regexp_replace("core", "(?:" + marks + r"|(?<![\p{L}\p{N}])(?:undefined|null|nan)(?![\p{L}\p{N}]))", "\x01")
    quoted = f'(?:{QUOTES}\\s*\\x01\\s*{QUOTES}|{DOUBLE}[^"“”«»„`]{{0,30}}\\x01[^"“”«»„`]{{0,30}}{DOUBLE})'
    spoken = f"{SPEAKS}{QUOTES}?\\x01"
    about = noted.rlike(TOPICS) | ((F.coalesce("_words", F.lit(THIN)) >= THIN) & noted.rlike(f"^(?=.*{quoted})(?=.*(?:{NEAR}|{ASKS}))|^(?=.*{spoken})(?=.*{NEAR})"))
    low = F.lower("_raw")
    held = (F.contains("core", F.lit("undefined")) | F.contains("core", F.lit("null"))) & F.col("core").rlike(SLOT)
    held = held | ((F.contains(low, F.lit("undefined")) | F.contains(low, F.lit("null")) | F.contains(low, F.lit("nan"))) & F.col("_raw").rlike(VALUE))
    unrendered = F.col("terms").isin(*UNRENDERED) | ((many <= 3) & F.arrays_overlap(bits, F.array(*[F.lit(x) for x in ("undefined", "null", "nan")])))
    reason = (
        F.when((marked | held) & ~about, F.when(marked, "placeholder").otherwise("unrendered")).when(unrendered, "unrendered").when(bare.rlike(whole(FILLER)), "filler")
        .when(bare.rlike(whole(ERRORS)), "error").when(bare.rlike(whole(NOTICES)), "notice").when((many <= SHORT_CORE) & F.col("terms").rlike(MENTIONS), "message")
    )
    long = F.array_distinct(F.filter(bits, lambda w: F.length(w) >= 3))
    rows = rows.withColumns({"reason": reason, "_many": many, "_thin": F.coalesce("_words", F.lit(0)) < THIN, "_fits": F.arrays_overlap(bits, "_slug"), "_backed": (F.size(long) > 0) & (F.size(F.array_intersect(long, "_body")) * 2 >= F.size(long))})
    point = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    known = F.coalesce(F.col("reason").isin("filler", "error", "notice"), F.lit(False))
    points = F.when(F.col("reason").isin("placeholder", "unrendered"), RESIDUE).otherwise(
        F.when(known, 2).when(F.col("reason") == "message", 1).otherwise(0) + point(~F.col("_fits") & ~F.col("_backed")) + point(F.col("_thin") | (known & F.col("_failed")))
    )
    return rows.withColumn("points", points)


def repeated_cores(rows: DataFrame, slugs: DataFrame) -> DataFrame:
    """(terms, _n): cores that host evidence decides, and how many of `rows` have each. rows: terms (numbers as 0), _site, _thin,
    _fits, _backed. slugs: (_slug, _site) of all pages."""
    spread = rows.groupBy("terms", "_site").agg(F.count("*").alias("_n"), F.max("_thin").alias("_thin"), F.max("_fits").alias("_fits"), F.min("_backed").alias("_backed"))
    share = lambda c: F.count(F.when(F.col(c), 1))
    evidence = spread.groupBy("terms").agg(F.sum("_n").alias("_n"), F.count("*").alias("_hosts"), share("_thin").alias("_thin"), share("_fits").alias("_fits"), share("_backed").alias("_backed"))
    low = evidence.filter((F.col("_thin") >= HOSTS) & (F.col("_thin") >= F.col("_hosts") * THIN_HOSTS) & (F.col("_fits") == 0) & (F.col("_backed") * 2 < F.col("_hosts"))).select("terms", "_n")
    named = slugs.select("_site", F.explode("_slug").alias("_term")).distinct().groupBy("_term").agg(F.count("*").alias("_hosts")).filter(F.col("_hosts") >= HOSTS).select("_term")
    matched = low.select("terms", F.explode(F.array_distinct(F.split("terms", " "))).alias("_term")).join(named, "_term", "left_semi").select("terms").distinct()
    return low.join(matched, "terms", "left_anti")


def residue(pages: DataFrame, *, id: str, title: str, url: str, words: str, status: str, description: str | None = None, headings: str | None = None) -> DataFrame:
    """(id, reason, points): the pages to exclude; reason `repeated` is decided by host evidence alone.

    description (a text) and headings (an array) are the body's columns; without them nothing but the slug can support a title.
    Null, blank and punctuation-only titles are no case. A null count of words is taken as 0, a null status as no error, a null
    address gives no site, no slug and no host evidence. Repeated rows give one. Empty tables give an empty result; other columns are
    ignored. The examined pages are written to the checkpoint folder when this is called.
    """
    spark = pages.sparkSession
    checkpoint_dir(spark)
    found = examined(pages, id=id, title=title, url=url, words=words, status=status, description=description, headings=headings)
    numberless = F.regexp_replace("terms", r"\p{N}+", "0")
    found = found.select("_id", "reason", "points", "_site", "_thin", "_fits", "_backed", F.when((F.col("points") < RESIDUE) & (F.col("_site") != "") & (F.col("_many") <= SHORT_CORE), numberless).alias("terms")).checkpoint()
    direct = found.filter(F.col("points") >= RESIDUE).select("_id", "reason", "points")
    rest = found.filter("terms IS NOT NULL")
    slugs = pages.select(site_words(F.col(url)).alias("_site"), slug_terms(F.col(url)).alias("_slug")).filter("_site != ''")
    cores = repeated_cores(rest, slugs).checkpoint()
    total = cores.agg(F.sum("_n")).first()[0] or 0
    repeated = skew.joined(rest.select("_id", "terms"), cores, ["terms"], count="_n", total=total, how="left_semi").select("_id", F.lit("repeated").alias("reason"), F.lit(RESIDUE).alias("points"))
    return direct.unionByName(repeated).groupBy("_id").agg(F.min("reason").alias("reason"), F.max("points").alias("points")).withColumnRenamed("_id", id)
