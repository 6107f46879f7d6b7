"""Declared schemas, as DDL: inference breaks on empty arrays, on pages keyed by number and on unsigned 64-bit hashes."""

from __future__ import annotations

#: Node arrays of a document in the order that breaks ties of reading order.
ARRAYS = ("texts", "tables", "pictures", "groups", "key_value_items", "form_items")

_REF = "struct<`$ref`:string>"
_BBOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
_CELL = (
    f"struct<bbox:{_BBOX},row_span:int,col_span:int,start_row_offset_idx:int,end_row_offset_idx:int,"
    "start_col_offset_idx:int,end_col_offset_idx:int,text:string,column_header:boolean,row_header:boolean,row_section:boolean>"
)
_REFS = ",".join(f"{x}:array<{_REF}>" for x in ("captions", "references", "footnotes"))
_NODE = (
    f"struct<self_ref:string,parent:{_REF},children:array<{_REF}>,content_layer:string,label:string,"
    f"prov:array<struct<page_no:int,bbox:{_BBOX},charspan:array<int>>>,orig:string,text:string,level:int,enumerated:boolean,"
    f"marker:string,name:string,key:string,value:string,data:struct<table_cells:array<{_CELL}>,num_rows:int,num_cols:int,grid:array<array<{_CELL}>>>,"
    f"{_REFS},annotations:array<map<string,string>>>"
)


DOCUMENT = (
    "schema_name string, version string, name string, origin struct<mimetype:string,binary_hash:decimal(20,0),filename:string>,"
    + ",".join(f"{x} struct<self_ref:string,children:array<{_REF}>,content_layer:string,name:string,label:string>" for x in ("furniture", "body"))
    + ","
    + ",".join(f"{a} array<{_NODE}>" for a in ARRAYS)
    + ", pages map<string,struct<size:struct<width:double,height:double>,page_no:int>>, _corrupt string"
)
PHRASE = "id int, phrase string, bbox array<double>, page int, font string, size double, bold int, is_underline int, all_cap int, num_st int, is_center int"
QUESTION = "id int, category string, description string, answer_format string, `group` string"
RESULT = (
    "doc_path string, question_text string, question_category string, true_answer string, llm_global_answer string,"
    "provenance_nodes array<struct<node_id:string,node_text:string,llm_answer:string,node_summary:string,header_text:string,"
    "page_no:int,total_pages:int,tree_node:int,tree_header_num:int>>"
)
OCR_WORD = "page int, text string, conf double, left double, top double, width double, height double, page_width double"
