"""Product rows, texts and URLs projected from the test tables, in SQL that
both engines read alike."""

from __future__ import annotations

#: Raw product rows of every kind: valid, incomplete, misnamed, sponsored.
PRODUCTS = """
SELECT CAST(p.p_partkey AS BIGINT) AS ordinal,
  CASE p.p_partkey % 7 WHEN 0 THEN concat(p.p_name, ' Case Cover ', p.p_type) WHEN 1 THEN concat(p.p_name, ' Wireless Earbuds Bluetooth')
    WHEN 2 THEN concat('  ', p.p_name, '   ', p.p_type, '  ') WHEN 3 THEN p.p_name WHEN 4 THEN concat(p.p_name, ' cables & chargers')
    WHEN 5 THEN CASE WHEN p.p_partkey % 5 = 0 THEN 'Untitled' ELSE concat(p.p_name, ' ', p.p_type) END
    ELSE CASE WHEN p.p_partkey % 6 = 0 THEN NULL ELSE concat(p.p_type, '-', p.p_name) END END AS title,
  CASE WHEN p.p_partkey % 11 = 0 THEN NULL WHEN p.p_partkey % 13 = 0 THEN 0.0 WHEN p.p_partkey % 17 = 0 THEN -5.0
    WHEN p.p_partkey % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p.p_retailprice END AS price,
  CASE WHEN p.p_size = 50 THEN 5.5E0 ELSE CAST(p.p_size AS DOUBLE) / 10 END AS rating,
  CAST(coalesce(l.n, 0) AS DOUBLE) AS rating_count,
  CASE WHEN p.p_partkey % 5 = 0 THEN NULL WHEN p.p_partkey % 23 = 0 THEN 12.5E0 ELSE CAST(p.p_size * 37 AS DOUBLE) END AS review_count,
  CASE WHEN p.p_partkey % 4 = 0 THEN NULL WHEN p.p_partkey % 8 = 1 THEN 'data:image/png;base64,AA' ELSE concat('https://img.example/', CAST(p.p_partkey AS STRING), '.jpg') END AS image,
  CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE concat('https://img.example/', CAST(p.p_partkey AS STRING), '.jpg') END AS image_url,
  CASE p.p_partkey % 8 WHEN 0 THEN concat('/x/dp/B', lpad(CAST(p.p_partkey AS STRING), 9, '0')) WHEN 1 THEN NULL WHEN 2 THEN 'javascript:void(0)'
    WHEN 3 THEN concat('https://www.flipkart.com/item/p/itm', CAST(p.p_partkey AS STRING)) WHEN 4 THEN 'https://shop.example/Navy/p/1'
    WHEN 5 THEN concat('https://www.amazon.in/product-reviews/', CAST(p.p_partkey AS STRING)) WHEN 6 THEN '#' ELSE concat('https://other.example/product/', CAST(p.p_partkey AS STRING)) END AS url,
  CASE WHEN p.p_partkey % 3 = 1 THEN NULL ELSE concat('https://www.amazon.in/dp/B', lpad(CAST(p.p_partkey AS STRING), 9, '0')) END AS canonical_url,
  CASE WHEN p.p_partkey % 9 = 0 THEN 'id' WHEN p.p_partkey % 10 = 0 THEN NULL ELSE concat(' b', lpad(CAST(p.p_partkey AS STRING), 9, '0')) END AS product_id,
  CASE WHEN p.p_partkey % 10 = 0 THEN NULL ELSE concat('B', lpad(CAST(p.p_partkey AS STRING), 9, '0')) END AS asin,
  p.p_size % 10 = 0 AS sponsored, p.p_size % 10 = 0 AS is_sponsored,
  CASE p.p_partkey % 3 WHEN 0 THEN 'Amazon' WHEN 1 THEN 'Flipkart' ELSE NULL END AS source,
  CASE p.p_partkey % 3 WHEN 0 THEN 'Amazon' WHEN 1 THEN 'Flipkart' ELSE NULL END AS marketplace
FROM {part} p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey
"""

#: Copies of products: each customer's orders are copies of one card.
COPIES = """
SELECT CAST(o_orderkey AS BIGINT) AS ordinal,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('Card ', CAST(o_custkey AS STRING)) END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 6 AS DOUBLE) END AS rating,
  CAST(o_orderkey % 7 AS DOUBLE) AS rating_count, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey % 1000 AS DOUBLE) END AS review_count,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'https://img.example/a.jpg' END AS image_url,
  CASE WHEN o_custkey % 11 = 0 THEN concat('https://www.amazon.in/dp/', CAST(o_custkey AS STRING)) ELSE NULL END AS canonical_url,
  CASE WHEN o_custkey % 11 < 2 THEN NULL ELSE concat('B', lpad(CAST(o_custkey AS STRING), 9, '0')) END AS asin,
  o_orderstatus = 'F' AS is_sponsored, o_orderstatus = 'F' AS sponsored
FROM {orders}
"""

#: Prices as shops write them.
PRICE_TEXTS = """
SELECT p_partkey AS id, CASE p_partkey % 9
  WHEN 0 THEN concat('₹', CAST(p_partkey AS STRING)) WHEN 1 THEN concat('₹1,', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'), '.50')
  WHEN 2 THEN concat('Rs. ', CAST(p_partkey AS STRING)) WHEN 3 THEN concat('INR ', CAST(p_partkey AS STRING), ' (approx)')
  WHEN 4 THEN concat('Rs. ', CAST(p_partkey AS STRING), ' Rs.') WHEN 5 THEN concat('( 1,29,', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'), ' )')
  WHEN 6 THEN 'not a price' WHEN 7 THEN '' ELSE concat('rs', CAST(p_partkey AS STRING), ' inr') END AS raw
FROM {part}
"""

#: Counts as shops write them.
COUNT_TEXTS = """
SELECT p_partkey AS id, CASE p_partkey % 16
  WHEN 0 THEN concat('92,', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'), ' ratings') WHEN 1 THEN concat(CAST(p_size AS STRING), '.4K ratings')
  WHEN 2 THEN concat(CAST(p_size AS STRING), ' lakh+ ratings') WHEN 3 THEN concat('1.', CAST(p_size AS STRING), ' crore ratings')
  WHEN 4 THEN concat(CAST(p_size AS STRING), 'M reviews') WHEN 5 THEN concat('1,', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'), 'K')
  WHEN 6 THEN '4.6 out of 5 stars' WHEN 7 THEN concat(CAST(p_size AS STRING), '% off') WHEN 8 THEN concat(CAST(p_partkey AS STRING), ' global ratings')
  WHEN 9 THEN concat(CAST(p_size AS STRING), 'K+ bought in past month') WHEN 10 THEN concat('(', CAST(p_partkey AS STRING), ')')
  WHEN 11 THEN concat(CAST(p_partkey AS STRING), ' Ratings & ', CAST(p_size AS STRING), ' Reviews') WHEN 12 THEN CAST(p_partkey AS STRING)
  WHEN 13 THEN concat(CAST(p_size AS STRING), '.2L Ratings') WHEN 14 THEN '' ELSE concat('₹', CAST(p_partkey AS STRING), ' off on ', CAST(p_size AS STRING), ' items') END AS raw
FROM {part}
"""

#: Queries as they are typed.
QUERY_TEXTS = """
SELECT p_partkey AS id, CASE p_partkey % 10
  WHEN 0 THEN concat(p_name, ' under ', CAST(p_size * 100 AS STRING)) WHEN 1 THEN concat('  ', upper(p_name), '!!  for the ', p_type)
  WHEN 2 THEN concat(p_name, ' below rs ', CAST(p_size AS STRING), ',000') WHEN 3 THEN concat('₹', CAST(p_size AS STRING), ' ', p_name, ' cases')
  WHEN 4 THEN concat(p_name, ' between ', CAST(p_size AS STRING), ' and ', CAST(p_size * 2 AS STRING)) WHEN 5 THEN concat('bear   buds with ', p_name, ' batteries')
  WHEN 6 THEN concat('iphone ', CAST(p_size AS STRING)) WHEN 7 THEN 'the of and' WHEN 8 THEN concat('usb c cables less than INR ', CAST(p_size AS STRING))
  ELSE concat(p_name, ' glass constructor Headphones up to $', CAST(p_size AS STRING)) END AS raw
FROM {part}
"""

#: Page URLs: those of the pages, and search pages of the shops made of them.
PAGE_URLS = """
SELECT page_id AS id, CASE page_id % 12
  WHEN 0 THEN concat('https://www.amazon.in/s?k=wireless+ear%20buds&page=', CAST(page_id AS STRING), '&ref=sr_pg_2&qid=1', '#top')
  WHEN 1 THEN concat('/s/?page=2&ref_=x&k=a&k=a&pd_rd=1&n=', CAST(page_id AS STRING)) WHEN 2 THEN concat('https://WWW.Amazon.in:443/s/b/?rh=n%3A1&k=a%26b&', CAST(page_id AS STRING))
  WHEN 3 THEN concat('https://www.flipkart.com/search?q=red+shoes&page=', CAST(page_id AS STRING)) WHEN 4 THEN concat('https://www.meesho.com/search?q=', CAST(page_id AS STRING), '%20kurti')
  WHEN 5 THEN concat('https://www.myntra.com/shoes?q=&search=run+', CAST(page_id AS STRING)) WHEN 6 THEN concat('http://m.amazon.in/s?k=x', CAST(page_id AS STRING))
  WHEN 7 THEN concat('https://www.amazon.in/boat/dp/B0ABCDEF', lpad(CAST(page_id % 100 AS STRING), 2, '0'), '/ref=sr_1?k=q') WHEN 8 THEN 'javascript:void(0)'
  WHEN 9 THEN concat('https://www.amazon.com/gp/cart?ref=', CAST(page_id AS STRING)) ELSE url END AS url
FROM {pages}
"""

#: Links of product cards.
PRODUCT_LINKS = """
SELECT p_partkey AS id, CASE p_partkey % 8
  WHEN 0 THEN concat('/boAt-Rockerz/dp/b0abc', lpad(CAST(p_partkey % 100000 AS STRING), 5, '0'), '/ref=sr_1_1?keywords=boat') WHEN 1 THEN concat('https://www.amazon.com/gp/product/B0ABC', lpad(CAST(p_partkey % 100000 AS STRING), 5, '0'))
  WHEN 2 THEN concat('/widget/p/itm', CAST(p_partkey AS STRING), '?lid=1&pid=acc', CAST(p_partkey AS STRING)) WHEN 3 THEN concat('/widget/p/itm', CAST(p_partkey AS STRING), '/x?lid=1')
  WHEN 4 THEN concat('/s/p/', CAST(p_partkey AS STRING), 'ab?x=1') WHEN 5 THEN concat('https://www.meesho.com/p/shirt/p/', lpad(CAST(p_partkey AS STRING), 4, 'z'))
  WHEN 6 THEN concat('https://shop.example/a/b//?q=', CAST(p_partkey AS STRING)) ELSE '' END AS href,
  CASE p_partkey % 4 WHEN 0 THEN concat('a', CAST(p_partkey AS STRING), '.jpg 200w, b.jpg 400w, c.jpg 400w') WHEN 1 THEN ' one.jpg' WHEN 2 THEN 'x.jpg 1x,  y.jpg 2x , ' ELSE '' END AS srcset
FROM {part}
"""

_NUMBER = "lpad(CAST(p_partkey AS STRING), 9, '0')"
#: Search pages of the three shops, each of one card made of a part.
SHOP_PAGES = f"""
SELECT p_partkey AS page_id, p_size, p_name,
  CASE p_partkey % 3 WHEN 0 THEN 'https://www.amazon.in/s?k=bolts' WHEN 1 THEN 'https://www.flipkart.com/search?q=red+bolts' ELSE 'https://meesho.com/search?q=bolts%20x' END AS url,
  CASE p_partkey % 3 WHEN 0 THEN concat('<html><body><input id="twotabsearchtextbox" value="', CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END, '"><div data-component-type="s-search-result" data-asin="b', {_NUMBER},
      '"><h2><a class="a-link-normal" href="/x/dp/B', {_NUMBER}, '/ref=sr_1"><span>', p_name, ' ', p_type, ' original product</span></a></h2>', CASE WHEN p_size % 10 = 0 THEN '<div><span> Sponsored </span></div>' ELSE '' END,
      '<span class="a-price a-text-price" data-a-strike="true"><span class="a-offscreen">₹9,999</span></span><span class="a-price"><span class="a-offscreen">₹1,', lpad(CAST(p_size AS STRING), 3, '0'),
      '</span></span><i class="a-icon a-icon-star-small"><span class="a-icon-alt">4.', CAST(p_size % 10 AS STRING), ' out of 5 stars</span></i><span aria-label="', CAST(p_size * 37 AS STRING),
      ' ratings"></span><img class="s-image" width="200" srcset="a.jpg 1x, b', CAST(p_size AS STRING), '.jpg 2x"></div><nav><a href="/s?k=bolts&page=2">Next</a></nav>',
      CASE WHEN p_size % 3 = 0 THEN '<button>Load more</button>' ELSE '' END, '</body></html>')
    WHEN 1 THEN concat('<body><p>top<div data-id="x"><a class="_4rR01T" href="/w/p/itm', CAST(p_partkey AS STRING), '?pid=acc', CAST(p_partkey AS STRING), '"> ', p_name, '  ', p_type, '</a><div class="_3LWZlK">4.', CAST(p_size % 10 AS STRING),
      '</div><span class="_2U9tEA"><span>', CAST(p_size * 1000 AS STRING), ' Ratings &amp; ', CAST(p_size AS STRING), ' Reviews</span></span><div class="_30jeq3">₹', CAST(p_size AS STRING), ',499</div>',
      CASE WHEN p_size % 10 = 0 THEN '<span> Ad </span>' ELSE '' END, '<img src="data:image/gif;base64,A"><img src="https://rukminim2.flixcart.com/', CAST(p_partkey AS STRING), '.jpg"></div><a class="_1LKTO3" href="/search?q=red&page=2">Next</a></body>')
    ELSE concat('<body><div data-id="m"><a href="/shirt/p/', lpad(CAST(p_partkey AS STRING), 4, 'z'), '"><p>', p_name, ' kurti</p></a><span class="priceNow">₹', CAST(p_size AS STRING), '9</span><span class="AverageRating">3.', CAST(p_size % 10 AS STRING),
      '</span><span class="RatingsCount">', CAST(p_size AS STRING), '.5K Ratings</span>', CASE WHEN p_size % 10 = 0 THEN '<b class="GoldBadge">Meesho Gold</b>' ELSE '' END, '<img data-src="https://images.meesho.com/', CAST(p_partkey AS STRING), '.webp"></div></body>') END AS html
FROM {{part}}
"""

#: Cards whose fields lie in other places than usual: a kind of card each.
CARD_KINDS = """
SELECT p_partkey AS page_id, p_size, p_name, CASE WHEN p_partkey % 12 < 4 THEN 'https://www.amazon.in/s?k=x' WHEN p_partkey % 12 < 8 THEN 'https://www.flipkart.com/search?q=x' ELSE 'https://www.meesho.com/search?q=x' END AS url,
  concat(CASE WHEN p_partkey % 12 < 4 THEN '<div data-component-type="s-search-result">' WHEN p_partkey % 12 < 8 THEN '<div data-id="f">' ELSE '<div data-id="m"><a href="/shirt/p/abc123"></a>' END, CASE p_partkey % 12
    WHEN 0 THEN concat('<span class="a-size-base-plus a-color-base a-text-normal"> Sponsored  ', p_name, ' plus</span><span class="a-price"><span class="a-price-whole">1,', lpad(CAST(p_size AS STRING), 3, '0'),
      '</span></span><i class="a-icon-star"><span class="a-icon-alt">4.1 out of 5 stars</span></i><a href="/x#customerReviews"><span>3,', lpad(CAST(p_size AS STRING), 3, '0'), '</span></a>')
    WHEN 1 THEN concat('<div><h2><span>TV 42</span></h2><i> with a stand and ', p_name, '</i></div><span class="a-price" data-a-strike="true"><span class="a-offscreen">₹9,999</span></span><span class="a-price-whole">2,', lpad(CAST(p_size AS STRING), 3, '0'),
      '</span><i aria-label="3.5 out of 5 stars"></i>')
    WHEN 2 THEN concat('<h2><span>', p_name, ' wide screen set</span><div>9,999 ratings</div></h2><div>', CAST(p_size * 100 AS STRING),
      ' reviews</div><i class="a-icon-star-small"><span class="a-icon-alt">6.5 out of 5 stars</span></i><i class="a-icon-star-medium"><span class="a-icon-alt">4</span></i>')
    WHEN 3 THEN '<h2><span>Sponsored</span></h2>'
    WHEN 4 THEN concat('<div class="xproduct-title"> ', p_name, '   x </div><span class="mainprice">(₹1,', lpad(CAST(p_size AS STRING), 3, '0'), ')</span><b class="big-rating">4.2 stars</b><span class="rating-count">', CAST(p_size AS STRING),
      ' Ratings</span><span class="review-count">', CAST(p_size + 1 AS STRING), ' Ratings</span>')
    WHEN 5 THEN concat('<a>12345</a><a>abcd</a><a>', p_name, ' by link</a><span>', CAST(p_size AS STRING), ' Ratings</span><span>', CAST(p_size + 1 AS STRING), ' Reviews</span><i>Only ₹ 2,', lpad(CAST(p_size AS STRING), 3, '0'), ' today</i>')
    WHEN 6 THEN concat('<i class="_2cLu-l">ab</i><i class="_2cLu-l">', p_name, '</i><i class="_1vC4OE">₹0</i><span class="lowprice">₹', CAST(p_size + 700 AS STRING), '</span><i class="_1nLEql">9 out</i><b class="user-rating">3</b><span>₹5 off 10 ratings</span><span>5% of 10 reviews</span>')
    WHEN 7 THEN '<a>1234567</a>'
    WHEN 8 THEN concat('<h4>₹99</h4><h4>', p_name, ' kurti set</h4><div class="sellingPrice">₹', CAST(p_size + 200 AS STRING), '</div>')
    WHEN 9 THEN concat('<span class="ItemName">12345</span><span class="itemname">', p_name, '</span><i>₹500 ₹ ', CAST(p_size + 300 AS STRING), ' ₹0</i>')
    WHEN 10 THEN concat('<p>plain text</p><i data-testid="productTitle"> ', p_name, '  saree</i><span class="oldMRP">₹ 1,', lpad(CAST(p_size AS STRING), 3, '0'), '</span>')
    ELSE '<h3>12</h3><h2>₹ 20</h2>' END, '</div>') AS html
FROM {part}
"""

#: The third shop's pages and their links to a next page: a kind each.
NEXT_LINKS = """
SELECT p_partkey AS page_id, 'https://www.meesho.com/search?q=x' AS url, CASE p_partkey % 6
  WHEN 0 THEN concat('<a href="/first">1</a><a rel="next" href="/search?page=', CAST(p_size AS STRING), '">Next</a>')
  WHEN 1 THEN concat('<a rel="next" href="/x" aria-disabled="true">Next</a><button class="nextBtn" href="/pl/', CAST(p_size AS STRING), '">→</button>')
  WHEN 2 THEN concat('<a class="Nextlink" href="https://other.example/2">Next</a><a href="https://www.meesho.com/search?page=', CAST(p_size AS STRING), '"> NEXT PAGE </a>')
  WHEN 3 THEN '<a href="/z">Next one</a>'
  WHEN 4 THEN concat('<a rel="next">Next</a><a href="/q?page=', CAST(p_size AS STRING), '">next</a>')
  ELSE '<a rel="next" href="/a">Onward</a>' END AS html
FROM {part}
"""

#: Result pages of 20 searches, a card each; the links of some lead back, to
#: another search, to a page that is not there, or nowhere.
RESULT_PAGES = """
SELECT p_partkey AS page_id, s, n, p_size, concat('https://www.amazon.in/s?k=bolt+s', CAST(s AS STRING), CASE WHEN n > 1 THEN concat('&page=', CAST(n AS STRING)) ELSE '' END, '&ref=sr_pg') AS url,
  concat('<input id="twotabsearchtextbox" value="', CASE WHEN s % 2 = 1 THEN 'bolt set' ELSE '' END, '"><div data-component-type="s-search-result" data-asin="B', lpad(CAST((n - 1) % 3 AS STRING), 9, '0'),
    '"><h2><a href="/x/dp/B', lpad(CAST((n - 1) % 3 AS STRING), 9, '0'), '"><span>Part', CAST(p_partkey AS STRING), CASE WHEN n % 4 = 2 THEN ' nut' ELSE ' bolt' END, ' original product</span></a></h2><span class="a-price"><span class="a-offscreen">₹',
    CAST(1000 + 20 * p_size AS STRING), '</span></span><span aria-label="', CAST(p_size * 37 AS STRING), ' ratings"></span><img class="s-image" src="a.jpg"></div>',
    CASE WHEN s % 5 = 1 AND n = 3 THEN concat('<nav><a href="/s?k=bolt+s', CAST(s AS STRING), '&page=2&qid=4">Next</a></nav>') WHEN s % 5 = 2 AND n = 2 THEN '<nav><a href="/s?k=other&page=3">Next</a></nav>'
      WHEN s % 5 = 3 AND n = 2 THEN '' WHEN s % 5 = 4 AND n = 3 THEN concat('<nav><a href="/s?k=bolt+s', CAST(s AS STRING), '&page=99999">Next</a></nav>')
      ELSE concat('<nav><a href="/s?k=bolt+s', CAST(s AS STRING), '&page=', CAST(n + 1 AS STRING), '&qid=7">Next</a></nav>') END) AS html
FROM (SELECT p_partkey, p_size, CAST((p_partkey - 1) % 20 AS INT) AS s, CAST(floor((p_partkey - 1) / 20) AS INT) + 1 AS n FROM {part} WHERE p_partkey > 0) p
"""

#: The searches that ask for them.
SEARCHES = """
SELECT CAST(p_partkey - 1 AS BIGINT) AS search, concat('https://www.amazon.in/s?ref=nb&k=bolt+s', CAST(p_partkey - 1 AS STRING)) AS url, CASE WHEN p_partkey % 3 = 0 THEN 'bolt under 1500' ELSE NULL END AS query,
  CAST(NULL AS DOUBLE) AS low, CASE WHEN p_partkey % 4 = 1 THEN CAST(1500 AS DOUBLE) ELSE NULL END AS high
FROM {part} WHERE p_partkey BETWEEN 1 AND 20
"""
