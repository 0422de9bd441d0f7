"""Explicit schemas (DDL) of the corpus: papers with nested reviews, programs, talks, words of laid-out pages."""

from __future__ import annotations

REVIEW = (
    "struct<reviewer_num:int,score_raw:int,score_max:int,score_normalized:double,recommendation_label:string,"
    "post_rebuttal_label:string,post_rebuttal_score_raw:int,score_changed:boolean,confidence_raw:int,confidence_label:string,"
    "clarity_label:string,text_contribution:string,text_strengths:string,text_weaknesses:string,text_detailed_comments:string,"
    "text_reproducibility:string,text_post_rebuttal_justification:string,text_ethics:string,review_stack_rank:int,review_stack_size:int>"
)
META_REVIEW = "struct<meta_reviewer_num:int,recommendation:string,text:string>"

PAPERS = (
    "paper_id string, title string, abstract string, url string, year int, authors array<string>, subject_areas array<string>, "
    "pdf_url string, doi string, shared_it_url string, supp_url string, code_url string, dataset_urls array<string>, "
    "has_code boolean, early_accepted boolean, rebuttal_provided boolean, lncs_volume string, bibtex_key string, bibtex_raw string, "
    "num_reviews int, score_range int, avg_score_raw double, avg_score_normalized double, author_feedback_text string, "
    f"reviews array<{REVIEW}>, meta_reviews array<{META_REVIEW}>, umap_x double, umap_y double, cluster_id int, cluster_label string, "
    "presentation_type string, oral_session string, oral_session_id string, error string"
)
PRESENTATION = "struct<type:string,title_raw:string,authors_raw:array<string>,speaker:string,page:int,column:int,order:int>"
PROGRAM = (
    "year int, source_pdf string, n_sessions int, n_presentations int, sessions array<struct<session_id:string,session_title:string,"
    f"session_kind:string,day:string,room:string,chairs:array<string>,presentations:array<{PRESENTATION}>>>"
)
TALKS = ("paper_id string, type string, session_id string, session_title string, day string, match string")
OVERRIDES = ("year int, norm_title string, paper_id string, is_skip boolean")
EMBEDDINGS = ("paper_id string, embedding array<float>, cluster_id int, ord long")
WORDS = ("doc string, page int, text string, fontname string, size double, x0 double, x1 double, top double, page_width double")
LINES = ("doc string, page int, col int, ord int, text string, size double, x0 double, top double, bold boolean, italic boolean, new_flow boolean")
YEARS = (
    "year int, era string, score_field_substring string, score_parse_mode string, post_rebuttal_has_score boolean, review_scale_max int, "
    "coauthorship_network_min_papers int, num_top_papers int, n_submitted int, city string, "
    "extra_review_fields array<struct<label_substring:string,store_as:string>>"
)
