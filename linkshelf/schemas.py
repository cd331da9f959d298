"""Schemas of the tables the jobs read and write."""

METADATA = "url string, title string, description string, tags array<string>, creator string"
LEDGER = "url string, event string, ts timestamp, source string, category string, `into` string"
STATE = (
    "url string, status string, prompt_version string, attempts int, last_error string, updated_at string"
)
CLASSIFIED = "Category string, Summary string, Creator string, URL string, Title string, Tags string"
LABELLED = "label string, href string, value string"
EXPORT_POST = (
    "label_values array<struct<label:string,href:string,value:string,title:string,"
    f"dict:array<struct<dict:array<struct<{LABELLED.replace(' string', ':string').replace(', ', ',')}>>>>>>"
)
INFO = (
    "title string, description string, uploader string, channel string, tags array<string>, duration double, "
    "`_type` string, entries array<struct<url:string,thumbnail:string>>, playlist_count int, "
    "subtitles map<string,array<struct<ext:string,url:string>>>, "
    "automatic_captions map<string,array<struct<ext:string,url:string>>>, webpage_url string"
)
ANALYSIS = (
    "media_shape string, category string, secondary_categories array<string>, confidence double, title string, "
    "summary string, findings array<string>, language string, "
    "evidence struct<had_speech:boolean,had_on_screen_text:boolean,had_music:boolean,slides_seen:int>, "
    "list_expected_count int, items array<struct<kind:string,name:string,artist:string,location_name:string,"
    "country:string,position:int,source:string,notes:string>>, recategorize boolean, completeness_notes string, "
    "needs_visuals boolean, relevance double, content_tags array<string>"
)
REQUEST_LOG = "ts timestamp, key string, provider string, in_tokens bigint, out_tokens bigint"
