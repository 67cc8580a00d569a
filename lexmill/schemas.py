"""Explicit schemas of everything that is read or written."""



class Schema(str):
    """A schema as DDL text; ``names`` are its columns, for schemas without nested fields."""

    @property
    def names(self) -> list[str]:
        return [x.split()[0] for x in self.split(",")]


ddl = Schema
ARTICLE = ddl("title string, url string, content string, category string, author string, image_url string, publish_date timestamp_ntz, comment_count int")
ARTICLE_JSON = ddl("Title string, Url string, Content string, Category string, Author string, ImageUrl string, PublishDate string, CommentCount int")
JUDGEMENT = "struct<position:int,documentId:string,title:string,url:string,category:string,author:string,relevanceScore:int,comment:string,aiRelevanceScore:int,aiConfidence:float,aiReason:string>"
EVALUATION = ddl(f"queryId string, queryText string, timestamp timestamp, category string, author string, totalFound bigint, comment string, results array<{JUDGEMENT}>")
SYNONYMS = ddl("synonyms map<string,array<string>>, lastUpdated timestamp, totalGroups int, confidenceScores map<string,double>, statistics struct<totalWords:int,totalPairs:int,minSimilarity:double,avgSimilarity:double,maxSimilarity:double,articlesAnalyzed:int>")
QUERY_STATS = "struct<Query:string,SearchCount:int,SuccessfulSearches:int,TotalResults:int,FirstSeen:timestamp,LastSeen:timestamp,CorrectedFrom:array<string>>"
SAMPLE = ddl("queryId string, queryText string, documentId string, title string, contentSnippet string, category string, author string, elasticScore double, position int, label int, confidence float, timestamp timestamp")
FINE_TUNING = ddl("instruction string, response string, input string, output string")
BACKUP = ddl("Timestamp timestamp, IndicesCount int, Indices array<struct<Name:string,DocumentCount:bigint,ActualDocumentCount:bigint,MappingFile:string,SettingsFile:string,DataFile:string>>")
EVENT = ddl("query string, corrected_from string, found bigint, at timestamp")
