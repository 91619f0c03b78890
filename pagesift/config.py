"""Workload constants.

Fixed values that must equal the reference's behaviour:
  collection dimension 384, collection metric dot product,
  article length limit: fewer than 1200 words (split on a single space),
  encode batch 5, insert batch 100,
  answers per query 1 to 50, default 1,
  crawl sitemap keywords "/post-sitemap", "/slideshow-sitemap", "/video-sitemap",
  crawl tags: index element "sitemap", sitemap element "url", link element "loc".
"""

COLLECTION_DIM = 384
COLLECTION_METRIC = "dot"
MAX_WORDS = 1200
ENCODE_BATCH = 5
INSERT_BATCH = 100
K_MIN, K_MAX = 1, 50
SITEMAP_KEYWORDS = ["/post-sitemap", "/slideshow-sitemap", "/video-sitemap"]
SITEMAP_TAG, URL_TAG, LOC_TAG = "sitemap", "url", "loc"

# Scores and distances are compared after rounding to this many digits.
SCORE_DIGITS = 6

# Size bound for anything shipped to every task (query batches, hit lists).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
