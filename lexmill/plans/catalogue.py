"""The driver's queries over the test tables, and their SQL.

Documents stand for articles: url ``doc://<doc_id>``, title the first line, content the text, category the
language, author the source. The tables hold no Cyrillic, so the alphabet is a parameter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import values as V
from ..operators import analysis as A
from ..operators import analytics as AN
from ..operators import evaluation as E
from ..operators import html as H
from ..operators import pipeline as PL
from ..operators import search as S
from ..operators import spell as SP
from ..operators import synonyms as Y
from ..operators import training as TR
from ..operators.components import shared_dir
from ..sources import store

ABC = "a-z"
STOP = ["the", "and", "der", "die", "que", "les"]
OPTIONS = Y.Options(min_frequency=5, alphabet=ABC, stop=tuple(STOP))
WHOLE = Y.Options(alphabet=ABC, stop=tuple(STOP))  # the reference's defaults: words of two articles and more
QUERY = "the tion of ering thtion"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def articles(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc://"), "doc_id").alias("url"), F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("content"), F.col("lang").alias("category"), F.col("source").alias("author"),
    )


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return A.doc_tokens(articles(spark, d), alphabet=ABC, stop=STOP)


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as judgements: a query per source, in order of doc_id, relevance quality + toxic."""
    j = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id")
    w = Window.partitionBy("source").orderBy("doc_id")
    return j.select(F.col("source").alias("query_id"), F.concat(F.lit("query "), "source").alias("query_text"), F.row_number().over(w).alias("position"), (F.col("quality") + F.col("toxic")).alias("relevance"), F.col("doc_id").alias("document_id"))


def search_log(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("query"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("clik "), F.col("user_id").cast("string"))).alias("corrected_from"),
        F.when(F.col("event_type") != "error", F.floor("value") + 1).otherwise(0).cast("long").alias("found"), F.col("ts").alias("at"),
    )


Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ART = "art as (select doc_id id,'doc://'||doc_id url,string_split(text,chr(10))[1] title,text as content,lang category,source author from documents)"
PIECES = r"regexp_split_to_array(lower({c}),'[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+')"
STOPS = ",".join(f"'{w}'" for w in STOP)
TOK = f"{ART}, tok as (select distinct id,word from (select id,unnest({PIECES.format(c='content')}) word from art) where regexp_full_match(word,'[a-z]{{3,50}}') and word not in ({STOPS}))"
DF = f"{TOK}, df as (select word,count(*) df from tok group by word)"
JUD = "jud as (select source query_id,'query '||source query_text,row_number() over (partition by source order by l.doc_id) as position,quality+toxic relevance,l.doc_id document_id from labels l join documents d on l.doc_id=d.doc_id)"
LOG = "lg as (select event_type||' '||user_id query,case when event_type='click' then 'clik '||user_id end corrected_from,case when event_type<>'error' then floor(value)+1 else 0 end::bigint as found,ts as seen from events)"


@query("select doc_id,md5(lower(regexp_replace(text,'^\\s+|\\s+$','','g'))) normal from documents")
def normalize_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normal"))


@query("select page_id,rtrim(replace(replace(base64(unhex(sha256(url))),'/','_'),'+','-'),'=') id from pages")
def article_id(spark, d):
    return _t(spark, d, "pages").select("page_id", T.article_id(F.col("url")).alias("id"))


@query("select page_id,case when trim(p)='' then null when starts_with(p,'//') then 'https:'||p when starts_with(p,'/') then 'https://example.org'||p else p end full_url from (select page_id,case page_id%3 when 0 then url when 1 then regexp_replace(url,'^https?://[^/]+','') else regexp_replace(url,'^https?:','') end p from pages)")
def normalize_url(spark, d):
    bare = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "^https?://[^/]+", "")).otherwise(F.regexp_replace("url", "^https?:", ""))
    return _t(spark, d, "pages").select("page_id", T.normalize_url(bare, "https://example.org").alias("full_url"))


@query("select page_id,contains(url,'example') and not contains(url,'#') and url<>'https://example.org' and url<>'https://example.org/' and not regexp_matches(url,'/en/\\d{2}-\\d{2}-\\d{4}$') and not regexp_matches(lower(url),'/login|/register|/about|/contact|/search|/tag|/author|/hall-of-fame|/member/|/help') and (contains(url,'/de/') or (contains(url,'/en/') and not contains(url,'/en?page='))) is_article from pages")
def is_article_url(spark, d):
    return _t(spark, d, "pages").select("page_id", T.is_article_url(F.col("url"), "example", "https://example.org", "/en/", "/de/").alias("is_article"))


@query(f"with {TOK} select id,word from tok")
def tokenize(spark, d):
    return tokens(spark, d)


@query(f"with {DF} select word,df::bigint df from df")
def doc_frequency(spark, d):
    return A.word_frequencies(tokens(spark, d))


@query(f"with {DF} select word,df::bigint df from df where df between 2 and 50")
def filter_by_frequency(spark, d):
    return A.filter_by_frequency(A.word_frequencies(tokens(spark, d)), 2, 50)


CASES = f"""{ART}, raw as (select unnest(regexp_split_to_array(title,'[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')||regexp_split_to_array(content,'[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')) w from art)
, cs as (select lower(w) word,sum(case when regexp_matches(w,'^[A-Z]') then 1 else 0 end)::bigint capitalised,sum(case when regexp_matches(w,'^[A-Z]') then 0 else 1 end)::bigint lower_case from raw where regexp_full_match(w,'[A-Za-z]{{3,}}') group by 1)"""


@query(f"with {CASES} select word,capitalised,lower_case,capitalised/(capitalised+lower_case) ratio from cs")
def word_case_stats(spark, d):
    return A.case_stats(articles(spark, d), "a-z")


@query(f"with {CASES} select word,capitalised,lower_case,capitalised/(capitalised+lower_case) ratio from cs where capitalised>=2 and capitalised/(capitalised+lower_case)>=0.8")
def proper_nouns(spark, d):
    return A.proper_nouns(A.case_stats(articles(spark, d), "a-z"))


@query(f"with {DF} select word,count(*)::bigint n,string_agg(id::varchar,',' order by id) ids from tok join df using(word) where df between 2 and 200 and word<>'for' group by word")
def inverted_index(spark, d):
    p = A.posting_lists(A.inverted_index(tokens(spark, d), 2, 200, ["for"]))
    return p.select("word", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query()
def inverted_index_all(spark, d):
    """Without a limit of document frequency, as by the reference's default; a row per posting, so no word is one row or task."""
    return A.inverted_index(tokens(spark, d)).select("word", "id", "df")


PAIRS = f"""{DF}, big as (select id,word,df from tok join df using(word) where df>=5)
, pr as (select x.word word1,y.word word2,x.df df1,y.df df2,count(*) co from big x join big y on x.id=y.id and x.word<y.word and least(x.df,y.df)>=0.25*greatest(x.df,y.df) group by all)
, pairs as (select word1,word2,df1::bigint df1,df2::bigint df2,co::bigint co,round(co/(df1+df2-co),9) jaccard,round(co/sqrt(df1*df2),9) cosine from pr where co>=2 and co/(df1+df2-co)>=0.25)"""


def _pairs(spark, d, top=False, o=OPTIONS) -> DataFrame:
    return Y.word_pairs(A.doc_words(articles(spark, d), alphabet=ABC, stop=STOP), o, top=top)


def _shown(p: DataFrame) -> DataFrame:
    return p.select("word1", "word2", "df1", "df2", "co", F.round("jaccard", 9).alias("jaccard"), F.round("cosine", 9).alias("cosine"))


@query(f"with {PAIRS} select * from pairs")
def cooccurrence_pairs(spark, d):
    return _shown(_pairs(spark, d))


@query(f"with {PAIRS} select * from pairs qualify row_number() over (partition by word1 order by jaccard desc,word2)<=15")
def top_synonyms(spark, d):
    return _shown(Y.top_pairs(_shown(_pairs(spark, d))))


@query(f"with {PAIRS} select count(*)::bigint total_pairs,round(min(jaccard),6) min_similarity,round(avg(jaccard),6) avg_similarity,round(max(jaccard),6) max_similarity,(select count(distinct word1) from pairs)::bigint total_words,(select count(*) from documents)::bigint articles_analyzed from pairs")
def mining_stats(spark, d):
    s = Y.mining_stats(_pairs(spark, d), articles(spark, d))
    return s.select("total_pairs", *[F.round(c, 6).alias(c) for c in ("min_similarity", "avg_similarity", "max_similarity")], "total_words", "articles_analyzed")


@query(f"""with recursive {PAIRS}, e as (select word1 a,word2 b from pairs where jaccard>=0.9 union select word2,word1 from pairs where jaccard>=0.9)
, r(a,b) as (select a,a from e union select r.a,e.b from r join e on r.b=e.a) select a word,min(b) as label from r group by a""")
def synonym_groups(spark, d):
    return Y.groups(_pairs(spark, d).filter("jaccard >= 0.9"))


@query(f"""with {PAIRS}, p as (select word1,word2,least(len(word1),len(word2)) n from pairs)
select word1,word2 from p where word1=word2 or (n>=3 and (left(word1,least(4,n-1))=left(word2,least(4,n-1)) or (n>=4 and right(word1,4)=right(word2,4)) or 1-levenshtein(word1,word2)/greatest(len(word1),len(word2))>=0.78))""")
def morph_variant_pairs(spark, d):
    return _pairs(spark, d).filter(Y.morphological(F.col("word1"), F.col("word2"))).select("word1", "word2")


@query("select doc_id,((len(lower(text))-len(replace(lower(text),'of the','')))/6)::bigint n from documents")
def phrase_occurrences(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.occurrences(F.col("text"), F.lit("of the")).alias("n"))


ALL_PAIRS = PAIRS.replace("df>=5", "df>=2")
BEST = "qualify row_number() over (partition by word1 order by jaccard desc,word2)<=15"
MORPH = "(n>=3 and (left(word1,least(4,n-1))=left(word2,least(4,n-1)) or (n>=4 and right(word1,4)=right(word2,4)) or 1-levenshtein(word1,word2)/greatest(len(word1),len(word2))>=0.78))"
MINED = f"""{ALL_PAIRS}, best as (select * replace (co/(df1+df2-co) as jaccard),least(len(word1),len(word2)) n from pairs {BEST})
, {CASES[len(ART) + 2 :]}, names as (select word from cs where capitalised>=2 and capitalised/(capitalised+lower_case)>=0.8)
, seq as (select string_split(lower(unnest([title,content])),' ') w from art), ad as (select w,unnest(range(1,len(w))) i from seq)
, gr as (select regexp_extract(w[i],'([a-z]+)$',1) x,regexp_extract(w[i+1],'^([a-z]+)',1) y from ad)
, strong as (select least(x,y) word1,greatest(x,y) word2 from gr where x<>'' and y<>'' group by all having count(*)>=3)
, valid as (select word1,word2,jaccard from best anti join strong using(word1,word2) where least(len(word1),len(word2))>=3 and greatest(len(word1),len(word2))<=30 and not {MORPH} and word1 not in (select word from names) and word2 not in (select word from names))
, me as (select b.word1 word,avg(v.jaccard) m from best b left join valid v on b.word1=v.word1 and b.word2=v.word2 group by 1)
, cf as (select word,round(case when m is null then 0.5 else least(1.0,m) end,9) confidence from me where word in (select word1 from valid union select word2 from valid))"""
KINDS = ",".join(f"('{V.SPORT}','{k}'),('{k}','{V.SPORT}')" for k in V.SPORT_KINDS)


@query(f"with {MINED}, ed as (select word1 word,word2 synonym from valid union select word2,word1 from valid union select * from (values {KINDS}) t(a,b)) select word,synonym,confidence from ed left join cf using(word)")
def mine_synonyms(spark, d):
    e, c, _ = Y.mine(articles(spark, d), WHOLE)
    return e.join(c, "word", "left").withColumn("confidence", F.round("confidence", 9))


@query(f"with {MINED} select word,confidence from cf")
def synonym_confidences(spark, d):
    return Y.mine(articles(spark, d), WHOLE)[1].withColumn("confidence", F.round("confidence", 9))


# the same queries over all pairs, as the reference mines them; those above are held to words of five articles and more


@query(f"with {ALL_PAIRS} select * from pairs")
def cooccurrence_pairs_all(spark, d):
    return _shown(_pairs(spark, d, o=WHOLE))


@query(f"with {ALL_PAIRS} select * from pairs {BEST}")
def top_synonyms_all(spark, d):
    return _shown(Y.top_pairs(_shown(_pairs(spark, d, o=WHOLE))))


@query(f"with {MINED} select count(*)::bigint total_pairs,round(min(jaccard),6) min_similarity,round(avg(jaccard),6) avg_similarity,round(max(jaccard),6) max_similarity,(select count(distinct word1) from pairs)::bigint total_words,(select count(*) from documents)::bigint articles_analyzed from valid")
def mining_stats_all(spark, d):
    s = Y.mine(articles(spark, d), WHOLE)[2]
    return s.select("total_pairs", *[F.round(c, 6).alias(c) for c in ("min_similarity", "avg_similarity", "max_similarity")], "total_words", "articles_analyzed")


@query()
def synonym_groups_all(spark, d):
    return Y.groups(_pairs(spark, d, o=WHOLE))


@query(f"with {ALL_PAIRS}, p as (select word1,word2,least(len(word1),len(word2)) n from pairs) select word1,word2 from p where {MORPH}")
def morph_variant_pairs_all(spark, d):
    return _pairs(spark, d, o=WHOLE).filter(Y.morphological(F.col("word1"), F.col("word2"))).select("word1", "word2")


DICT = [("big", "large"), ("big", "huge"), ("fast", "quick")]


@query("select * from (values ('q1','a big huge large car'),('q2','fast quick')) t(query_id,expanded)")
def expand_query(spark, d):
    q = spark.createDataFrame([("q1", "a big car"), ("q2", "Fast ")], "query_id string, query string")
    e = spark.createDataFrame(DICT, "word string, synonym string")
    return Y.expand_query(q, e)  # synonyms of a word come in the order of the alphabet


@query("select * from (values ('big, huge, large'),('fast, quick')) t(rule)")
def synonym_rules(spark, d):
    return Y.synonym_rules(Y.synonym_groups(spark.createDataFrame(DICT, "word string, synonym string")))


ESTOP = ",".join(f"'{w}'" for w in V.ENGLISH_STOP_WORDS)


def _bm25(where: str, page: str, words=("tion", "ering", "thtion"), whole_query: str = QUERY, fuzzy: bool = False) -> str:
    def field(f: str) -> str:
        return f"select '{f}' field,id,list_filter({PIECES.format(c=f)},lambda x: x<>'' and x not in ({ESTOP})) terms from art"

    whole = " union all ".join(f"select '{f}',id,[lower(trim({f}))] from art" for f in S.WHOLE_FIELDS)
    rows = ",".join([f"('{f}','{w}')" for f in S.TEXT_FIELDS for w in words] + [f"('{f}','{whole_query}')" for f in S.WHOLE_FIELDS])
    asked = f", {'q0' if fuzzy else 'qt'} as (select * from (values {rows}) t(field,term))"
    if fuzzy:
        edits = "case when len(q0.term)<3 then 0 when len(q0.term)<=5 then 1 else 2 end"
        near = r"damerau_levenshtein(q0.term,regexp_replace(vo.term,'[^\x00-\x7F]','?','g'))"  # it counts bytes; the query is ASCII
        asked += f", qt as (select distinct field,term from (select vo.field,vo.term from q0 join vo using(field) where {near}<={edits} qualify row_number() over (partition by q0.term,vo.field order by {near},df desc,vo.term)<=50))"
    return f"""with {ART}, ft as ({field("title")} union all {field("content")} union all {whole})
, fl as (select field,id,len(terms) len,terms from ft where len(terms)>0)
, st as (select field,count(*) n,avg(len) al from fl group by field)
, po as (select field,id,term,count(*) tf from (select field,id,unnest(terms) term from fl) group by all)
, vo as (select field,term,count(*) df from po group by all)
{asked}
, sc as (select id,field,case field when 'title' then 3 else 1 end*sum(ln(1+(n-df+.5)/(df+.5))*tf*2.2/(tf+1.2*(.25+.75*len/al))) s from po join qt using(field,term) join vo using(field,term) join st using(field) join fl using(field,id) group by id,field)
, sd as (select id,max(s) score from sc join art using(id) {where} group by id)
select id,round(score,6) score,rn::int "rank",(select count(*) from sd)::bigint total from (select *,row_number() over (order by score desc,id) rn from sd) where {page}"""


def _search(spark, d, **kw) -> DataFrame:
    idx = S.build_index(articles(spark, d))
    hits = S.search(idx, S.query_terms(spark, {"q": QUERY}), **kw)
    return hits.select("id", F.round("score", 6).alias("score"), "rank", "total")


@query(_bm25("", "rn<=10"))
def bm25_search(spark, d):
    return _search(spark, d)


@query(_bm25("where category='en' and author='src1'", "rn<=10"))
def bm25_filtered(spark, d):
    return _search(spark, d, category="en", author="src1")


@query(_bm25("", "rn>10 and rn<=20"))
def bm25_page2(spark, d):
    return _search(spark, d, start=10)


@query(_bm25("", "rn<=10", fuzzy=True))
def fuzzy_search(spark, d):
    return _search(spark, d, fuzzy=True)


@query(_bm25("", "rn<=10"))
def index_roundtrip(spark, d):
    top = f"{_scratch(spark)}/index"
    S.save_index(S.build_index(articles(spark, d)), top)
    hits = S.search(S.load_index(spark, top), S.query_terms(spark, {"q": QUERY}))
    return hits.select("id", F.round("score", 6).alias("score"), "rank", "total")


@query(_bm25("where category='en'", "rn<=7", ("thtion", "ering"), "thtion ering"))
def search_pipeline(spark, d):
    top = f"{_scratch(spark)}/index"
    S.save_index(S.build_index(articles(spark, d)), top)
    chain = SP.Chain([(1, "levenshtein", SP.levenshtein_checker({}, ["thtion"]))])
    e = spark.createDataFrame([("thtion", "ering"), ("thtion", "doubtful")], "word string, synonym string")
    c = spark.createDataFrame([("ering", 0.9), ("doubtful", 0.2)], "word string, confidence double")
    a = PL.answer(S.load_index(spark, top), "thtoin size=7 category=EN synmin=0.5", chain, e, c, fuzzy=False)
    return a.hits.select("id", F.round("score", 6).alias("score"), "rank", "total")


@query(f"""with {ART}, v as (select word,count(*) df from (select distinct id,unnest({PIECES.format(c="content")}) word from art) where regexp_full_match(word,'[a-z]+') group by word)
, q as (select * from (values ('ration'),('tion'),('th')) t(term)), m as (select term,word as match,levenshtein(term,word) edits,df from q join v on levenshtein(term,word)<=case when len(term)<3 then 0 when len(term)<=5 then 1 else 2 end)
select term,match,edits::int edits from m qualify row_number() over (partition by term order by edits,df desc,match)<=50""")
def fuzzy_terms(spark, d):
    idx = S.build_index(articles(spark, d), stop=[])
    q = spark.createDataFrame([("ration",), ("tion",), ("th",)], "term string")
    v = idx.vocab.filter((F.col("field") == "content") & F.col("term").rlike("^[a-z]+$"))
    return S.fuzzy_terms(q, v, transpositions=False).select("term", "match", "edits")


@query("""with w as (select * from (values ('moskow'),('speling'),('quite'),('zzz')) t(w)), dict as (select * from (values ('moscow',1),('spelling',2),('quiet',3),('quit',4)) t(x,i))
select w,(select x from dict where levenshtein(w,x) between 1 and 2 order by levenshtein(w,x),len(x) desc,i limit 1) best from w""")
def nearest_word(spark, d):
    w = spark.createDataFrame([("moskow",), ("speling",), ("quite",), ("zzz",)], "w string")
    return w.select("w", SP.nearest_word(F.col("w"), ["moscow", "spelling", "quiet", "quit"]).alias("best"))


WORDS = ["путин", "москва", "россия", "президент", "трамп", "киев", "ghbdtn", "Vjcrdf"]


@query("select w,translate(w,'qwertyuiop[]asdfghjkl;''zxcvbnm,./`~QWERTYUIOPASDFGHJKLZXCVBNM','йцукенгшщзхъфывапролджэячсмитьбю.ёЁЙЦУКЕНГШЩЗФЫВАПРОЛДЯЧСМИТЬ') t from (values " + ",".join(f"('{w}')" for w in WORDS) + ") t(w)")
def keyboard_translit(spark, d):
    return spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", T.switch_layout(F.col("w")).alias("t"))


@query(
    "with w as (select w,translate(w,'" + V.SOUND_LETTERS + "','" + V.SOUND_CODES + "') t from (values " + ",".join(f"('{w}')" for w in WORDS[:6]) + ") t(w)), c as (select w,t,unnest(range(1,len(t)+1)) i from w)"
    ", k as (select w,string_agg(t[i],'' order by i) s from c where i=1 or t[i]<>t[i-1] group by w) select w,left(w,1)||left(rpad(s[2:],4,'0'),4) code from k"
)
def phonetic_code(spark, d):
    return spark.createDataFrame([(w,) for w in WORDS[:6]], "w string").select("w", T.sound_code(F.col("w")).alias("code"))


@query("select * from (values ('путен','путин',true),('ghbdtn','ghbdtn',false),('vjcrdf','москва',true),('масква и киив','москва мир киев',true)) t(query,corrected,has_correction)")
def spell_chain(spark, d):
    q = spark.createDataFrame([("путен",), ("ghbdtn",), ("vjcrdf",), ("масква и киив",)], "query string")
    return SP.Chain().correct(q).select("query", "corrected", "has_correction")


METRICS = f"""{JUD}, rk as (select *,row_number() over (partition by query_id order by position) rn,count(*) over (partition by query_id) n from jud)
, ri as (select *,row_number() over (partition by query_id order by relevance desc,rn) ideal,(relevance>0)::int hit,sum((relevance>0)::int) over (partition by query_id order by rn) hits from rk)
, me as (select query_id,sum(case when rn<=1 then hit else 0 end)/least(1,max(n)) p_at_1,sum(case when rn<=5 then hit else 0 end)/least(5,max(n)) p_at_5,sum(case when rn<=10 then hit else 0 end)/least(10,max(n)) p_at_10,
 coalesce(sum(case when hit=1 then hits/rn end)/nullif(sum(hit),0),0) average_precision,coalesce(sum((pow(2,relevance)-1)/log2(rn+1))/nullif(sum((pow(2,relevance)-1)/log2(ideal+1)),0),0) ndcg,
 coalesce(1/min(case when hit=1 then rn end),0) reciprocal_rank,sum(hit)::bigint relevant_count,count(*)::bigint total_count from ri group by query_id)"""
MEASURES = ["p_at_1", "p_at_5", "p_at_10", "average_precision", "ndcg", "reciprocal_rank"]
TOTALS = f"{METRICS}, ov as (select count(*)::bigint total_queries,avg(average_precision) map,avg(ndcg) mean_ndcg,avg(reciprocal_rank) mrr,avg(p_at_1) mean_p_at_1,avg(p_at_5) mean_p_at_5,avg(p_at_10) mean_p_at_10,sum(total_count)::bigint documents_evaluated,sum(relevant_count)::bigint relevant_documents,sum(relevant_count)/sum(total_count) overall_precision from me)"
MEANS = ["map", "mean_ndcg", "mrr", "mean_p_at_1", "mean_p_at_5", "mean_p_at_10", "overall_precision"]


def _sql_round(cols: list[str]) -> str:
    return ",".join(f"round({c},9) {c}" for c in cols)


@query(f"with {METRICS} select query_id,{_sql_round(MEASURES)},relevant_count,total_count from me")
def ranking_metrics(spark, d):
    return E.metrics(judged(spark, d)).select("query_id", *[F.round(c, 9).alias(c) for c in MEASURES], "relevant_count", "total_count")


@query(f"with {TOTALS} select total_queries,documents_evaluated,relevant_documents,{_sql_round(MEANS)} from ov")
def overall_stats(spark, d):
    return E.overall(E.metrics(judged(spark, d))).select("total_queries", "documents_evaluated", "relevant_documents", *[F.round(c, 9).alias(c) for c in MEANS])


def _band(x: str) -> str:
    return f"(case when {x}>=0.8 then 0 when {x}>=0.6 then 1 when {x}>=0.4 then 2 else 3 end)::int"


@query(f"with {TOTALS} select {_band('map')} map_band,{_band('mean_p_at_1')} p1_band,{_band('mean_ndcg')} ndcg_band,{_band('(map+mean_ndcg+mrr+mean_p_at_1)/4')} level,(map<0.6 or mean_p_at_1<0.6) needs_advice from ov")
def quality_levels(spark, d):
    return E.levels(E.overall(E.metrics(judged(spark, d))))


@query(f"with {JUD} select b.r::int relevance,count(jud.query_id)::bigint n from (values (0),(1),(2)) b(r) left join jud on jud.relevance=b.r group by b.r")
def relevance_distribution(spark, d):
    return E.relevance_histogram(judged(spark, d))


@query(f"with {JUD} select position::int as position,sum((relevance>0)::int)::bigint relevant,count(*)::bigint n from jud group by 1")
def position_stats(spark, d):
    return E.position_stats(judged(spark, d))


@query(f"with {JUD} select count(distinct query_id)::bigint queries,count(*)::bigint documents,sum((relevance>0)::int)::bigint relevant from jud")
def basic_stats(spark, d):
    return E.basic_stats(judged(spark, d))


@query(f"with {JUD} select query_id,count(*)::bigint n,case when query_id in ('src1','src2') then 'new' else 'old' end state from jud where query_id<>'src3' group by 1")
def evaluation_upsert(spark, d):
    old = judged(spark, d).groupBy("query_id").agg(F.count("*").alias("n")).withColumn("state", F.lit("old"))
    new = old.filter(F.col("query_id").isin("src1", "src2")).withColumn("state", F.lit("new"))
    return E.delete(E.upsert(old, new), ["src3"])


STATS = f"{LOG}, qs as (select query,count(*)::bigint searches,sum((found>0)::int)::bigint successes,sum(found)::bigint total_results,min(seen) first_seen,max(seen) last_seen,coalesce(string_agg(distinct corrected_from,','),'') corrected_from from lg group by query)"


@query(f"with {STATS} select query,searches,successes,total_results,first_seen::varchar first_seen,last_seen::varchar last_seen,corrected_from,successes/searches success_rate,total_results/searches avg_results from qs")
def query_stats(spark, d):
    s = AN.query_stats(search_log(spark, d))
    stamp = lambda c: F.regexp_replace(F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "0+$", ""), r"\.$", "").alias(c)
    return s.select("query", "searches", "successes", "total_results", stamp("first_seen"), stamp("last_seen"), F.array_join("corrected_from", ",").alias("corrected_from"), "success_rate", "avg_results")


LEARNED = f"{STATS}, le as (select corrected_from original,max_by(query,seen) correction from lg where corrected_from is not null and corrected_from<>query and found>0 and query in (select query from qs where successes/searches>0.7) group by 1)"


@query(f"with {LEARNED} select original,correction from le")
def learned_corrections(spark, d):
    log = search_log(spark, d)
    return AN.learned_corrections(log, AN.query_stats(log))


@query(f"with {LEARNED} select count(*)::bigint unique_queries,sum(searches)::bigint total_searches,sum((successes/searches>0.5)::int)::bigint successful_queries,round(sum(successes)/sum(searches),9) success_rate,(select count(*) from le)::bigint learned_corrections from qs")
def analytics_totals(spark, d):
    log = search_log(spark, d)
    s = AN.query_stats(log)
    return AN.totals(s, AN.learned_corrections(log, s)).withColumn("success_rate", F.round("success_rate", 9))


@query(f"""with {LEARNED}, q as (select distinct query||'0' query from lg), good as (select query past from qs where searches>=2 and successes/searches>0.7)
, nr as (select query,past from q join good on abs(length(query)-length(past))<=2 and levenshtein(query,past) between 1 and 2 qualify row_number() over (partition by query order by levenshtein(query,past),past)=1)
select q.query,coalesce(le.correction,case when coalesce(qs.successes,0)=0 then nr.past end,q.query) corrected from q left join le on le.original=q.query left join qs on qs.query=q.query left join nr on nr.query=q.query""")
def analytics_correction(spark, d):
    log = search_log(spark, d)
    s = AN.query_stats(log)
    q = log.select(F.concat("query", F.lit("0")).alias("query")).distinct()
    return SP.analytics_correct(q, AN.learned_corrections(log, s), s).select("query", "corrected")


@query(r"select doc_id,left(regexp_replace(translate(text,chr(13)||chr(10),'  '),'^\s+|\s+$','','g'),700) s from documents")
def snippet(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), 700).alias("s"))


@query("""with recursive s as (select distinct source from documents), h(source,i,h) as (select source,0,2166136261::bigint from s union all select source,i+1,(xor(h,ascii(lower(source)[i+1])::bigint)::hugeint*16777619 % 4294967296)::bigint from h where i<len(source))
select source,h::bigint group_id from h where i=len(source)""")
def fnv_group_id(spark, d):
    return _t(spark, d, "documents").select("source").distinct().select("source", T.fnv1a(F.col("source")).alias("group_id"))


def _labelled(spark, d) -> DataFrame:
    j = judged(spark, d)
    return j.select("query_id", "query_text", "document_id", "position", F.col("relevance").alias("label"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("comment"), F.lit("2025-01-01").cast("timestamp").alias("at"))


@query(f"with {JUD}, {ART} select query_id as \"queryId\",query_text as \"queryText\",document_id as \"documentId\",title,left(regexp_replace(translate(content,chr(13)||chr(10),'  '),'^\\s+|\\s+$','','g'),700) as \"contentSnippet\",category,author,0.0::double as \"elasticScore\",position::int as position,least(greatest(relevance,0),2)::int as label from jud join art on document_id=art.id where relevance>=1")
def reranker_samples(spark, d):
    return TR.samples(_labelled(spark, d), articles(spark, d), min_score=1).drop("confidence", "timestamp")


PROMPT = "'" + V.JUDGE_PROMPT.replace("'", "''") + "'||chr(10)||'Запрос: '||query_text||chr(10)||'Документ:'||chr(10)||'Заголовок: '||title||chr(10)||'Категория: '||category||chr(10)||'Автор: '||author||chr(10)||'Ссылка: '||url||chr(10)||'Фрагмент: '||case when s='' then '[нет текста]' else left(s,600) end||chr(10)"
REASONS = " ".join(f"when {k} then '{v}'" for k, v in V.LABEL_REASON.items())


@query(f"with {JUD}, {ART}, fr as (select *,regexp_replace(translate(content,chr(13)||chr(10),'  '),'^\\s+|\\s+$','','g') s from art) select md5({PROMPT}) instruction,query_text as \"input\",relevance::int as label,(case relevance when 0 then 0.1 when 1 then 0.6 when 2 then 0.9 else 0.5 end)::double confidence,case relevance {REASONS} end reason from jud join fr on document_id=fr.id")
def finetuning_rows(spark, d):
    r = TR.fine_tuning(_labelled(spark, d), articles(spark, d))
    p = F.from_json("output", "label int, confidence double, reason string")
    return r.select(F.md5("instruction").alias("instruction"), "input", p["label"].alias("label"), p["confidence"].alias("confidence"), p["reason"].alias("reason"))


@query(f"with {JUD} select least(relevance,2)::int as label,count(*)::bigint n,count(*)/(select count(*) from jud) share from jud where contains(query_text,'src1') group by 1")
def label_distribution(spark, d):
    return TR.label_distribution(TR.samples(_labelled(spark, d), articles(spark, d)), text="SRC1")


@query(f"with {JUD} select count(*)::bigint pairs,count(distinct lower(query_text))::bigint queries from jud")
def dataset_summary(spark, d):
    return TR.summary(TR.samples(_labelled(spark, d), articles(spark, d)))


@query(f"with {JUD} select count(*)::bigint failed from jud where document_id not in (select doc_id from documents where lang='en')")
def missing_documents(spark, d):
    return TR.missing(_labelled(spark, d), articles(spark, d).filter("category = 'en'"))


CAND = f"""{ART}, rw as (select id,1 f,unnest(regexp_extract_all(lower(title),'[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')) word,generate_subscripts(regexp_extract_all(lower(title),'[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'),1) i from art
 union all select id,2,unnest(regexp_extract_all(lower(content),'[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')),generate_subscripts(regexp_extract_all(lower(content),'[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'),1) from art)
, tk as (select id,list(word order by o)[1:6] tok from (select id,word,min((f,i)) o from rw where regexp_full_match(word,'[a-z]{{3,50}}') and word not in ({STOPS}) group by id,word) group by id)
, nt as (select id,lower(trim(title)) t,list_filter(string_split(lower(trim(title)),' '),lambda x: len(x)>2) w,lower(trim(category)) c,lower(trim(author)) a from art)
, cd as (select id,list_filter([nullif(t,''),case when len(w)>=2 then w[1]||' '||w[2] end,case when len(w)>=3 then w[1]||' '||w[2]||' '||w[3] end]
 ||flatten(list_transform(coalesce(tok,[]),lambda x: [x,c||' '||x]))||[a,a||' '||tok[1]],lambda x: x is not null) q from nt left join tk using(id))"""


@query(f"with {CAND} select id,(generate_subscripts(q,1)-1)::int pos,unnest(q) query from cd")
def query_candidates(spark, d):
    return A.query_candidates(articles(spark, d), alphabet=ABC, stop=STOP)


@query(f"with {DF}, r as (select word,row_number() over (order by df desc,word) rn,lead(word) over (order by df desc,word) nx from (select * from df where df>=3 order by df desc,word limit 3000)) select rn::int \"rank\",word query from r where rn<=3000 union all select rn,word||' '||nx from r where nx is not null")
def fallback_queries(spark, d):
    return A.fallback_queries(A.word_frequencies(tokens(spark, d)))


@query()
def generate_queries(spark, d):
    return A.generate_queries(A.query_candidates(articles(spark, d), alphabet=ABC, stop=STOP), 100)


SITE = H.Site("https://example.org", "", "", news="/", articles="/")


@query()
def page_articles(spark, d):
    return H.articles(_t(spark, d, "pages"), SITE)


LINKS = """an as (select page_id,unnest(regexp_extract_all(html,'<a href="([^"]*)">[^<]*</a>',1)) href,unnest(regexp_extract_all(html,'<a href="[^"]*">([^<]*)</a>',1)) title,unnest(range(len(regexp_extract_all(html,'<a href="[^"]*">[^<]*</a>')))) i from pages)
, ok as (select page_id,'https://example.org'||href url,title,i from an where starts_with(href,'/') and not contains(href,'#') and href<>'/' and not regexp_matches(href,'/\\d{2}-\\d{2}-\\d{4}$') and not regexp_matches(lower(href),'/login|/register|/about|/contact|/search|/tag|/author|/hall-of-fame|/member/|/help') and len(title)>10 and len(title)<500)"""


@query(f"with {LINKS} select page_id,(row_number() over (partition by page_id order by max(i))-1)::int pos,url,min_by(title,i) title from ok group by page_id,url")
def page_links(spark, d):
    return H.page_links(_t(spark, d, "pages"), SITE)


@query()
def rerank_gbt(spark, d):
    j = _labelled(spark, d).withColumn("score", F.col("position") * 0.5)
    _, held = TR.train_reranker(TR.samples(j, articles(spark, d), by_user=False))
    return held.select("queryId", "documentId", "label", "rerank_score")


@query("select count(*)::bigint document_count,count(*)::bigint actual_count,count(*)::bigint restored from documents")
def backup_roundtrip(spark, d):
    top = _scratch(spark)
    a = articles(spark, d)
    a.write.parquet(f"{top}/docs")
    b = store.backup(spark, {"docs": f"{top}/docs"}, f"{top}/backup", "2025-01-01T00:00:00")
    r = store.restore(spark, f"{top}/backup", ["docs"], f"{top}/again", a.schema)
    return b.join(r, "name").drop("name")


CSV = {
    "QueryId": "query_id", "QueryText": "query_text", "Timestamp": "'2025-01-01 00:00:00'", "Position": "position::varchar", "DocumentId": "document_id::varchar", "Title": "title", "Url": "url",
    "Category": "category", "Author": "author", "RelevanceScore": "relevance::varchar", "Comment": "' say \"'||left(title,9)||'\", '||chr(10)||position||' '", "AiRelevanceScore": "case when position%2=0 then '1' else '' end",
    "AiConfidence": "case when position%2=0 then '0.250' else '' end", "AiReason": "''",
}


@query(f"with {JUD}, {ART} select " + ",".join(f'{v} as "{k}"' for k, v in CSV.items()) + " from jud join art on document_id=art.id")
def csv_export(spark, d):
    j = judged(spark, d).join(articles(spark, d).drop("content").withColumnRenamed("id", "document_id"), "document_id")
    even = F.col("position") % 2 == 0
    j = j.withColumns({
        "document_id": F.col("document_id").cast("string"), "at": F.lit("2025-01-01").cast("timestamp"), "comment": F.concat(F.lit(' say "'), F.left("title", F.lit(9)), F.lit('", \n'), F.col("position").cast("string"), F.lit(" ")),
        "ai_relevance": F.when(even, 1), "ai_confidence": F.when(even, 0.25).cast("float"), "ai_reason": F.lit(None).cast("string"),
    })
    path = f"{_scratch(spark)}/csv"
    store.write_csv(j, path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in CSV])


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"
