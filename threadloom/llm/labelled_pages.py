"""Small labelled pages that the content model is trained from.

``k="1"`` marks an element whose text belongs to the article, ``k="0"`` one inside it whose text does not; elements
without a mark take that of the element around them. The marks are no features.
"""

S = "The council met on Tuesday to discuss the new bridge, and most members agreed with the plan that was shown to them."
L = f"{S} Work should begin in spring, said the mayor. {S} It will take two years, and cost less than was feared at first."
T = "Rain is expected."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul>'
HEAD = '<html lang="en"><head><meta charset="utf-8"><title>Bridge plan agreed</title><style>p{}</style><script>go();</script></head>'

LABELLED_PAGES = (
    f'{HEAD}<body><nav>{MENU}</nav><div class="ad">Buy the best boots now.</div><article k="1"><h1>Bridge plan agreed</h1><p>{L}</p><p>{T}</p><p><b>{S}</b></p></article><footer>&copy; The Daily. All about the town and more.</footer></body></html>',
    f'{HEAD}<body><header class="site-header"><a href="/">The Daily</a><nav class="menu">{MENU}</nav></header><main><article k="1" class="post"><h1 class="title">Bridge plan</h1><p class="lead">{S}</p><p>{L}</p><h2>What next</h2><p>{T}</p><ul><li>{S}</li><li>{T}</li></ul></article><aside class="sidebar"><h3>Most read</h3>{MENU}</aside></main><footer class="site-footer"><p>Imprint and <a href="/p">privacy</a>.</p></footer></body></html>',
    f'{HEAD}<body><div id="top-nav" class="navbar">{MENU}</div><div id="content" class="content" k="1"><h1>Bridge</h1><div class="entry-content"><p>{L}</p><blockquote>{S}</blockquote><p>{S} <a href="/x">More</a> {S}</p></div><div class="share" k="0"><a href="/s">Share this</a></div></div><div class="comments" k="0"><h3>Comments</h3><div class="comment"><p>I like this plan a lot, thank you.</p></div><div class="comment"><p>{S}</p></div></div><div id="footer">All rights reserved.</div></body></html>',
    f'{HEAD}<body><div class="cookie-notice banner"><p>We use cookies to make this site better for you. <button>Accept</button></p></div><header><h2>Town news</h2></header><section class="story" k="1"><h1>Bridge</h1><p>{S}</p><p>{L}</p><figure><img src="a.jpg"><figcaption>{T}</figcaption></figure><p>{L}</p></section><section class="related"><h3>Related</h3>{MENU}</section><form action="/q" class="newsletter"><p>Sign up for our letter.</p><label>Mail</label><input name="m"></form><footer><p>{S}</p></footer></body></html>',
    f'{HEAD}<body><div class="wrapper"><div class="menu">{MENU}</div><div class="main"><div class="text" k="1"><p>{L}</p><p>{L}</p><p>{T}</p></div></div><div class="side widget"><p>Weather</p><p>Sunny, with some clouds later.</p></div></div></body></html>',
    f'{HEAD}<body><article k="1"><h1>Bridge</h1><p>{S}</p><div class="advert ad" k="0"><p>Buy boots. They are the best boots in town, and cheap.</p></div><p>{L}</p><aside k="0"><p>Read also: other bridges in the region and what they cost.</p></aside><p>{S}</p><table><tr><td>Cost</td><td>Two million</td></tr></table></article><section id="comments" class="reader-comments"><h2>Readers say</h2><ol><li><p>{S}</p></li><li><p>No, thank you.</p></li></ol><form><p>Leave a reply</p><textarea></textarea></form></section></body></html>',
    f'{HEAD}<body><p k="1">{L}</p><p k="1">{S}</p><p k="1">{T}</p></body></html>',
    f'{HEAD}<body><div class="breadcrumb"><a href="/">Home</a> <a href="/n">News</a></div><div role="main" class="article-body" k="1"><h1>Bridge</h1><h2>{T}</h2><p>{S} <em>{T}</em> {S}</p><p><strong>{T}</strong> {L}</p><pre>{S}</pre></div><div class="tags"><a href="/t">bridge</a> <a href="/u">town</a></div><div class="author-box notice"><p>Written by the desk. Contact us by mail.</p></div><div class="footer"><span>&copy; 2020 The Daily</span></div></body></html>',
    f'{HEAD}<body><div class="popup modal"><div class="notice"><p>Subscribe now and read all articles for one month.</p></div></div><nav><a href="/">Home</a><a href="/a">About</a></nav><main k="1"><h1>Bridge plan</h1><p>{S}</p><p>{T}</p><dl><dt>Length</dt><dd>{T}</dd></dl><p><span>{S}</span></p></main><div class="sponsored promo"><p>{T}</p></div><footer><ul><li><a href="/i">Imprint</a></li></ul></footer></body></html>',
    f'{HEAD}<body><header><div class="logo">Daily</div></header><article k="1"><p><b>{T}<br><p>{L}</p><p>{T}</p><p>Yes.</p></article><div class="ads"><p>{T}</p></div><footer>{T}</footer></body></html>',
)
