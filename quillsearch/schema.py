"""Schemas of stored tables, inputs and results, as DDL."""

SETUP = "key string, value binary"
ARTICLES = "id long not null, title string not null, entity string not null"
SECTIONS = "id long, article_id long, title string, content string, content_flate binary, pow int"
VOCABULARY = "term string"
VECTORS = "id long, embedding array<float>"
POSTINGS = "doc_id long, col tinyint, pos int, term string"
LENGTHS = "doc_id long, len int"
ANN = "section_id long, centroid_id int, chunk_id long, pos int, embedding array<double>"
CENTROIDS = "id int, centroid array<double>"
RESULT_COLUMNS = ["article_id", "title", "text", "type", "power", "snippet"]
RESULT = "article_id long, title string, text string, type string, power double, snippet string"
ITEMS = "array<struct<title:string,pow:int,content:string>>"
#: One JSON value per article, as found in the archives.
INPUT = "main_entity struct<identifier:string>, name string, article_body struct<html:string>, identifier long"
ARTICLE = "id long, title string, entity string, sections array<struct<id:long,title:string,content:string>>"
