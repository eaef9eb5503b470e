"""Schemas of the raw JSON-lines records: the fields that are read, all others are ignored."""

from __future__ import annotations

COUNTS = "works_count int, cited_by_count int, counts_by_year array<struct<year:int,works_count:int,cited_by_count:int,oa_works_count:int>>"
IDS = "ids struct<openalex:string,doi:string,mag:long,wikidata:string,wikipedia:string,ror:string,orcid:string,issn_l:string,pmid:string,pmcid:string>"
WORK = (
    "id string, doi string, display_name string, publication_year int, cited_by_count int, type string, is_retracted boolean, referenced_works array<string>, "
    "topics array<struct<id:string,score:double>>, locations array<struct<source:struct<id:string>,is_oa:boolean,version:string,license:string>>, "
    "authorships array<struct<author:struct<id:string>,institutions:array<struct<id:string>>,author_position:string,is_corresponding:boolean>>, "
    "biblio struct<volume:string,issue:string,first_page:string,last_page:string>, open_access struct<is_oa:boolean,oa_status:string,oa_url:string>, "
    f"counts_by_year array<struct<year:int,cited_by_count:int>>, {IDS}"
)
AUTHOR = f"id string, display_name string, orcid string, summary_stats struct<h_index:int,i10_index:int,2yr_mean_citedness:double>, {COUNTS}, {IDS}"
INSTITUTION = (
    "id string, display_name string, country_code string, display_name_acronyms array<string>, display_name_alternatives array<string>, "
    "geo struct<city:string,country_code:string,country:string,region:string,latitude:double,longitude:double>, "
    f"associated_institutions array<struct<id:string,relationship:string>>, {COUNTS}, {IDS}"
)
SOURCE = f"id string, display_name string, issn_l string, issn array<string>, alternate_titles array<string>, abbreviated_title string, {COUNTS}, {IDS}"
TOPIC = f"id string, display_name string, subfield struct<id:string>, field struct<id:string>, domain struct<id:string>, {COUNTS}, {IDS}"
SUBFIELD = f"id string, display_name string, field struct<id:string>, {COUNTS}, {IDS}"
FIELD = f"id string, display_name string, {COUNTS}, {IDS}"
CONCEPT = f"id string, display_name string, level int, ancestors array<struct<id:string>>, related_concepts array<struct<id:string,score:double>>, {COUNTS}, {IDS}"
PUBLISHER = f"id string, display_name string, country_codes array<string>, parent_publisher struct<id:string>, {COUNTS}, {IDS}"
SOURCE_QUARTILE = "publication_year int, id long, best_q int"
SOURCE_AREA = "id string, area string"

ENTITIES = {
    "works": WORK, "authors": AUTHOR, "institutions": INSTITUTION, "sources": SOURCE, "topics": TOPIC,
    "subfields": SUBFIELD, "fields": FIELD, "domains": FIELD, "concepts": CONCEPT, "publishers": PUBLISHER,
}
