"""Table schemas, as DDL."""

NODE = (
    "struct<pos:int,parent:int,last:int,tag:string,id:string,class:string,"
    "attrs:map<string,string>,own_text:string,text_start:int,text_end:int>"
)
NODES = f"array<{NODE}>"

RAW_PAGES = "page_id bigint, url string, html string, retrieved_time timestamp"
ATTRIBUTES = "array<struct<pos:int,key:string,value:string>>"
OFFER = (
    "struct<offer_id:bigint,nominal_value:decimal(18,2),currency:string,retrieved_time:timestamp,"
    "url:string,page_title:string,site:string,availability:string>"
)
# Order of an observation: rank of its source, then time, page and url.
SEQ = "struct<arrival:int,retrieved_time:timestamp,page_id:bigint,url:string>"

OBSERVATIONS = (
    "page_id bigint, url string, retrieved_time timestamp, title string, authors string, "
    "isbn string, description string, publisher string, format string, image_url string, "
    f"keywords array<string>, offer {OFFER}"
)
BOOKS = (
    "book_id bigint, isbn string, title string, authors string, description string, "
    f"publisher string, format string, image_url string, keywords array<string>, best_offer {OFFER}, "
    f"isbns array<string>, seqs struct<title:{SEQ},publisher:{SEQ},format:{SEQ},image_url:{SEQ},"
    f"book_id:{SEQ},authors:{SEQ},description:{SEQ},isbn:{SEQ},best_offer:{SEQ}>"
)
FRONTIER = (
    "url string, domain string, canonical_url string, title string, type string, "
    "retrieved_time timestamp, last_job string"
)
FRONTIER_ROWS = f"{FRONTIER}, seen_at timestamp"
OFFERS = f"{OFFER[len('struct<'):-1].replace(':', ' ')}, isbn string, job_id string"
WRAPPERS = "domain string, field string, query string, attr string"
WRAPPER_VERSIONS = f"{WRAPPERS}, valid_from timestamp"
JOBS = "job_id string, domain string, type string, status string, start timestamp, end timestamp"
FETCH_ATTEMPTS = "job_id string, url string, attempt int, ok boolean, download_ms bigint"
