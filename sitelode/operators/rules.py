"""The rule catalogue as a table, and its one evaluator.

A rule is a row: scope, severity, category, impact, effort, title, and a predicate over fact columns, all of the
latter SQL. A fact that wasn't observed is null and its rules don't fire. All rules of a scope are evaluated in
one projection (an array of structs per row, exploded), so facts are scanned once and there is no shuffle.

Facts of pages come from the HTML parser, headers and fetch records; facts of sites from aggregates and
captured probes. Titles are keys of the score, so their wording is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_FACTS = {
    "string": "site url final_url scheme title description lang canonical_host canonical_scheme canonical_path final_path final_host slug_path meta_robots x_robots refresh viewport content_encoding csp fetch_error cache_control template",
    "int": "status hops words h1_count heading_jumps h2_h4 internal_links imgs imgs_no_alt imgs_empty_alt imgs_no_size imgs_lazy imgs_legacy imgs_modern jsonld_blocks jsonld_invalid question_marks scripts script_tags blocking_scripts stylesheets elements body_bytes hops_trivial hreflangs missing_headers nosnippet_attrs title_sharers description_sharers repeated_sentences max_snippet hero_kb hero_status hero_hops google_fonts google_font_links font_kb share_width share_height share_status",
    "double": "elapsed_ms",
    "boolean": "client_rendered viewport_tag hreflang_self faq_schema mixed_content csp_missing nosnippet noarchive article_node dated is_home own_host_final hero_lazy hero_cross hero_srcset fonts_preconnect fonts_swap csp_blocks third_party_before_css has_share_image article_complete self_serving retired_types org_thin seen_template",
}
SITE_FACTS = {
    "string": "site missing_trust missing_mail_auth today security_expires",
    "int": "robots_status robots_bytes robots_sitemaps sitemap_urls sitemap_with_lastmod sitemap_lastmods sitemap_future ai_blocked_search ai_blocked_train variant_http variant_other variant_down probe_status cert_days domain_days pages deep_pages linked_sample links_broken links_5xx links_redirect links_trivial links_noncanonical links_noindex thinner_targets orphan_templates head_failures agents agents_ok agents_refused_answer agents_refused_train descriptions descriptions_no_cta max_depth affiliate_pages analysed near_pairs median_unique rating_conflicts owned_sites owned_shared exposed_files llms_status llms_dead llms_noncanonical stale_assets assets sm_checked sm_redirects sm_dead sm_noindex sm_noncanonical refused_pages contact_dead og_bytes favicon_bytes head_bytes psi_status psi_score home_status analytics ua_only small_imgs small_checked small_heavy",
    "boolean": "robots_html robots_found sitemap_found blocks_all probe_to_home contact_route any_text any_breadcrumb org_schema local_complete local_signals local_schema social_undeclared postal_found trust_seen dmarc dmarc_reports security_txt llms_format signal_search_no signal_input_no cdn_managed canonical_unlinked og_image og_title og_complete twitter_card title_cta description_cta psi_invalid",
    "double": "og_ratio",
}

P = "page"
S = "site"
#: (scope, severity, category, impact, effort, title, predicate); severity and title are SQL where they begin with '='. Titles, weights and thresholds are fixed values.
RULES = (
    (P, "CRITICAL", "crawlability", 5, 3, "Page unreachable", "fetch_error is not null or status = 0"),
    (P, "CRITICAL", "crawlability", 5, 3, "=concat('Server error ', status)", "status >= 500"),
    (P, "HIGH", "crawlability", 4, 2, "=concat('Client error ', status)", "status between 400 and 499"),
    (P, "MEDIUM", "crawlability", 3, 2, "=concat('Redirect chain (', hops, ' hops)')", "hops >= 2"),
    (P, "LOW", "crawlability", 2, 2, "Page redirects", "hops = 1 and coalesce(hops_trivial, 0) = 0"),
    (P, "CRITICAL", "crawlability", 5, 4, "Page may be client-rendered — content missing from raw HTML", "client_rendered"),
    (P, "HIGH", "ai search", 4, 4, "Content invisible to AI crawlers", "client_rendered"),
    (P, "HIGH", "crawlability", 4, 2, "Possible soft 404 (200 OK with empty body)", "words = 0 and status = 200 and coalesce(title, '') = ''"),
    (P, "HIGH", "crawlability", 4, 1, "Page set to noindex", "contains(lower(meta_robots), 'noindex') or lower(trim(meta_robots)) = 'none'"),
    (P, "HIGH", "crawlability", 4, 1, "Noindexed via X-Robots-Tag header", "contains(lower(x_robots), 'noindex') or lower(trim(x_robots)) = 'none'"),
    (P, "HIGH", "crawlability", 4, 2, "Meta-refresh redirect", "contains(lower(refresh), 'url=')"),
    (P, "HIGH", "on page", 4, 1, "Missing title tag", "title = ''"),
    (P, "LOW", "on page", 2, 1, "Title too long", "length(title) > 65"),
    (P, "LOW", "on page", 2, 1, "Title very short", "length(title) between 1 and 24"),
    (P, "MEDIUM", "on page", 3, 1, "Missing meta description", "description = ''"),
    (P, "LOW", "on page", 2, 1, "Meta description too long", "length(description) > 170"),
    (P, "LOW", "on page", 2, 1, "Meta description short", "length(description) between 1 and 69"),
    (P, "HIGH", "on page", 5, 1, "Missing H1 tag", "h1_count = 0 and not coalesce(client_rendered, false)"),
    (P, "LOW", "on page", 2, 1, "Multiple H1 tags", "h1_count > 1"),
    (P, "LOW", "on page", 1, 1, "Heading levels skip", "heading_jumps > 0"),
    (P, "MEDIUM", "on page", 3, 4, "Thin content (<300 words)", "words < 300 and status = 200 and not coalesce(client_rendered, false)"),
    (P, "LOW", "on page", 2, 1, "Long content without subheadings", "words >= 600 and h2_h4 = 0 and status = 200"),
    (P, "LOW", "on page", 2, 1, "Missing canonical tag", "canonical_path is null and canonical_host = '' and status = 200 and words > 0"),
    (P, "MEDIUM", "crawlability", 3, 1, "Canonical points to another domain", "canonical_scheme in ('http', 'https') and canonical_host <> final_host"),
    (P, "MEDIUM", "crawlability", 3, 1, "Canonical points at the http:// version", "canonical_host = final_host and canonical_scheme = 'http' and scheme = 'https'"),
    (P, "MEDIUM", "crawlability", 3, 1, "Canonicalized to a different URL", "canonical_host = final_host and not (canonical_scheme = 'http' and scheme = 'https') and rtrim('/', canonical_path) <> rtrim('/', final_path)"),
    (P, "LOW", "on page", 1, 3, "URL slug not clean", "slug_path rlike '[A-Z]|_|%20'"),
    (P, "LOW", "crawlability", 2, 1, "hreflang set lacks a self-reference", "hreflangs > 0 and not hreflang_self"),
    (P, "LOW", "on page", 2, 1, "Dead-end page (no internal links)", "status = 200 and words > 100 and internal_links = 0"),
    (P, "LOW", "on page", 1, 3, "Very high internal link count", "status = 200 and words > 100 and internal_links > 300"),
    (P, "=if(imgs_no_alt * 2 > imgs, 'MEDIUM', 'LOW')", "on page", 2, 2, "Images missing alt text", "imgs_no_alt > 0 and not coalesce(client_rendered, false)"),
    (P, "INFO", "on page", 1, 1, 'All images marked decorative (alt="")', "imgs >= 3 and imgs_no_alt = 0 and imgs_empty_alt = imgs and not coalesce(client_rendered, false)"),
    (P, "LOW", "schema", 2, 2, "No structured data (JSON-LD)", "jsonld_blocks = 0"),
    (P, "MEDIUM", "schema", 3, 1, "Invalid JSON-LD", "jsonld_invalid > 0"),
    (P, "MEDIUM", "schema", 3, 2, "FAQPage schema without visible FAQ content", "faq_schema and (question_marks < 2 or words < 80)"),
    (P, "CRITICAL", "trust", 5, 2, "Not served over HTTPS", "scheme <> 'https'"),
    (P, "MEDIUM", "trust", 3, 2, "Mixed content on an HTTPS page", "scheme = 'https' and mixed_content"),
    (P, "=if(csp_missing, 'MEDIUM', 'LOW')", "trust", 2, 2, "=concat('Missing ', missing_headers, ' security header(s)')", "missing_headers > 0"),
    (P, "HIGH", "mobile", 4, 1, "Missing viewport meta tag", "not viewport_tag"),
    (P, "MEDIUM", "mobile", 3, 1, "Viewport not responsive", "viewport_tag and not contains(lower(replace(viewport, ' ', '')), 'width=device-width')"),
    (P, "LOW", "mobile", 2, 1, "Viewport disables zoom", "viewport_tag and (contains(lower(replace(viewport, ' ', '')), 'user-scalable=no') or contains(lower(replace(viewport, ' ', '')), 'maximum-scale=1'))"),
    (P, "MEDIUM", "crawlability", 3, 2, "Server ignores Accept-Encoding", "status = 200 and lower(content_encoding) rlike '\\\\b(br|zstd)\\\\b'"),
    (P, "MEDIUM", "performance", 3, 1, "HTML served without compression", "status = 200 and body_bytes > 30720 and not coalesce(lower(content_encoding) rlike 'gzip|br|deflate|zstd', false)"),
    (P, "HIGH", "crawlability", 5, 3, "HTML exceeds Googlebot's 2 MB fetch limit", "status = 200 and body_bytes > 2097152"),
    (P, "MEDIUM", "performance", 3, 3, "Large HTML document", "status = 200 and body_bytes div 1024 > 300"),
    (P, "LOW", "performance", 2, 3, "Heavy HTML document", "status = 200 and body_bytes div 1024 between 121 and 300"),
    (P, "=if(blocking_scripts >= 3, 'MEDIUM', 'LOW')", "performance", 3, 2, "Render-blocking scripts in <head>", "status = 200 and blocking_scripts > 0"),
    (P, "MEDIUM", "performance", 2, 3, "Many resource requests", "status = 200 and scripts + stylesheets + imgs > 100"),
    (P, "LOW", "performance", 2, 3, "High resource count", "status = 200 and scripts + stylesheets + imgs between 51 and 100"),
    (P, "MEDIUM", "performance", 2, 3, "Very large DOM", "status = 200 and elements > 3000"),
    (P, "LOW", "performance", 2, 3, "Large DOM", "status = 200 and elements between 1501 and 3000"),
    (P, "=if(imgs_no_size * 2 > imgs and imgs >= 4, 'MEDIUM', 'LOW')", "performance", 3, 2, "Images without width/height (layout-shift risk)", "status = 200 and imgs_no_size > 0"),
    (P, "LOW", "performance", 2, 1, "No lazy-loading on images", "status = 200 and imgs >= 8 and imgs_lazy = 0"),
    (P, "LOW", "performance", 2, 2, "No modern image formats detected", "status = 200 and imgs_legacy >= 5 and imgs_modern = 0"),
    (P, "MEDIUM", "performance", 3, 3, "Slow server response", "status = 200 and elapsed_ms > 4000"),
    (P, "LOW", "performance", 2, 3, "Server response is slow", "status = 200 and elapsed_ms > 2000 and elapsed_ms <= 4000"),
    (P, "LOW", "ai search", 2, 1, "Missing html lang attribute", "lang = ''"),
    (P, "MEDIUM", "performance", 3, 1, "Priority image is lazy-loaded", "hero_status = 200 and hero_lazy"),
    (P, "MEDIUM", "performance", 4, 2, "Hero image is hotlinked cross-origin through redirects", "hero_cross and hero_hops > 0"),
    (P, "LOW", "performance", 3, 2, "Hero image is served from a third-party origin", "hero_cross and hero_hops = 0"),
    (P, "MEDIUM", "performance", 4, 2, "Hero image is very heavy", "hero_kb > 300 and not (hero_cross and hero_hops > 0)"),
    (P, "LOW", "performance", 3, 2, "Hero image is heavy and has no srcset", "hero_kb > 150 and not hero_srcset and (hero_kb <= 300 or (hero_cross and hero_hops > 0))"),
    (P, "LOW", "performance", 2, 1, "Google Fonts stylesheet is linked more than once", "google_font_links > google_fonts"),
    (P, "LOW", "performance", 2, 1, "Google Fonts without preconnect to fonts.gstatic.com", "google_fonts > 0 and not fonts_preconnect"),
    (P, "LOW", "performance", 2, 1, "Google Fonts requested without display=swap", "google_fonts > 0 and not fonts_swap"),
    (P, "=if(font_kb > 250, 'MEDIUM', 'LOW')", "performance", 3, 2, "Web font payload is heavy", "font_kb > 150"),
    (P, "MEDIUM", "performance", 3, 1, "Content-Security-Policy blocks a script the page loads", "csp_blocks"),
    (P, "LOW", "performance", 2, 1, "Third-party script is requested before the stylesheet", "third_party_before_css"),
    (P, "LOW", "performance", 2, 2, "HTML is served Cache-Control: no-store", "status = 200 and contains(lower(cache_control), 'no-store')"),
    (P, "LOW", "schema", 2, 1, "Article schema is missing recommended properties", "not article_complete"),
    (P, "MEDIUM", "schema", 3, 1, "Self-serving review markup on the business's own entity", "self_serving"),
    (P, "LOW", "schema", 3, 1, "Homepage Organization schema is thin", "is_home and org_thin"),
    (P, "INFO", "schema", 1, 1, "Schema types that no longer earn a Google rich result", "retired_types"),
    (P, "HIGH", "ai search", 4, 1, "Snippets are disabled for this page", "status = 200 and (nosnippet or max_snippet = 0)"),
    (P, "LOW", "ai search", 2, 1, "Snippet length is tightly capped", "status = 200 and not nosnippet and max_snippet between 1 and 49"),
    (P, "LOW", "ai search", 2, 1, "noarchive / nocache limits Bing Chat and Copilot", "status = 200 and noarchive"),
    (P, "LOW", "ai search", 2, 1, "Many elements are marked data-nosnippet", "status = 200 and nosnippet_attrs >= 5"),
    (P, "LOW", "ai search", 2, 1, "Article shows no visible publish/update date", "status = 200 and article_node and not dated"),
    (P, "LOW", "social", 2, 2, "Page has no share image of its own", "status = 200 and not is_home and not has_share_image and not coalesce(seen_template, false)"),
    (P, "MEDIUM", "social", 3, 1, "Share image does not load", "share_status <> 200"),
    (P, "LOW", "social", 2, 2, "Share image is small or not landscape", "share_status = 200 and (share_width < 600 or abs(share_width / share_height - 1.91) / 1.91 > 0.35)"),
    (P, "LOW", "on page", 1, 1, "The same sentence appears more than once on the page", "words >= 150 and repeated_sentences > 0"),
    (P, "MEDIUM", "on page", 3, 2, "Duplicate meta description across pages", "description_sharers > 1"),
    (P, "MEDIUM", "on page", 3, 2, "Duplicate title across pages", "title_sharers > 1"),
    (S, "LOW", "schema", 2, 1, "Social profiles not declared in sameAs schema", "social_undeclared"),
    (S, "HIGH", "trust", 4, 1, "HTTP version not redirected to HTTPS", "variant_http > 0"),
    (S, "MEDIUM", "crawlability", 3, 1, "Duplicate host serves the site without redirect", "variant_other > 0"),
    (S, "LOW", "crawlability", 2, 2, "Some host variants unreachable", "variant_down > 0"),
    (S, "MEDIUM", "crawlability", 3, 2, "Missing pages redirect to the homepage", "probe_status = 200 and probe_to_home"),
    (S, "HIGH", "crawlability", 4, 2, "Missing pages return HTTP 200 (soft 404)", "probe_status = 200 and not probe_to_home"),
    (S, "CRITICAL", "trust", 5, 2, "TLS certificate expired", "cert_days < 0"),
    (S, "HIGH", "trust", 4, 2, "TLS certificate expires very soon", "cert_days between 0 and 14"),
    (S, "MEDIUM", "trust", 3, 2, "TLS certificate expires within 30 days", "cert_days between 15 and 30"),
    (S, "MEDIUM", "trust", 3, 2, "No visible contact route", "not contact_route"),
    (S, "LOW", "trust", 2, 3, "=concat('Trust pages not found: ', missing_trust)", "missing_trust <> ''"),
    (S, "LOW", "performance", 2, 1, "Static assets lack long-lived caching", "assets > 0 and stale_assets = assets"),
    (S, "INFO", "on page", 1, 1, "No analytics detected", "analytics = 0"),
    (S, "LOW", "on page", 2, 1, "Only deprecated Universal Analytics found", "analytics > 0 and ua_only = analytics"),
    (S, "LOW", "crawlability", 2, 2, "Many sitemap URLs carry no <lastmod>", "sitemap_urls >= 10 and sitemap_with_lastmod < 0.8 * sitemap_urls"),
    (S, "LOW", "crawlability", 2, 2, "Every sitemap <lastmod> is the same date", "sitemap_with_lastmod >= 20 and sitemap_lastmods = 1"),
    (S, "LOW", "crawlability", 1, 1, "Sitemap <lastmod> dates in the future", "sitemap_future > 0"),
    (S, "MEDIUM", "ai search", 3, 2, "Site refuses every non-browser user-agent we tried", "home_status = 200 and agents > 0 and agents_ok = 0"),
    (S, "HIGH", "ai search", 5, 1, "AI search / assistant crawlers are refused at the edge", "agents_ok > 0 and agents_refused_answer > 0"),
    (S, "MEDIUM", "ai search", 3, 1, "AI training crawlers are refused at the edge", "agents_ok > 0 and agents_refused_answer = 0 and agents_refused_train > 0"),
    (S, "HIGH", "crawlability", 4, 1, "robots.txt AI-preference signal says search=no", "signal_search_no"),
    (S, "MEDIUM", "ai search", 3, 1, "robots.txt AI-preference signal opts out of AI answers", "signal_input_no"),
    (S, "INFO", "crawlability", 2, 1, "robots.txt is partly written by the CDN", "cdn_managed"),
    (S, "HIGH", "crawlability", 4, 2, "=concat('Broken internal links (', links_broken, ' of ', linked_sample, ' sampled)')", "links_broken > 0"),
    (S, "MEDIUM", "crawlability", 3, 3, "=concat('Internal links hit server errors (', links_5xx, ')')", "links_5xx > 0"),
    (S, "LOW", "crawlability", 2, 2, "=concat('Internal links point at redirects (', links_redirect, ' of ', linked_sample, ')')", "links_redirect >= 5"),
    (S, "LOW", "crawlability", 2, 1, "=concat('Internal links use URL variants that 301 (', links_trivial, ' of ', linked_sample, ')')", "links_trivial >= 3"),
    (S, "=if(canonical_unlinked, 'HIGH', 'MEDIUM')", "crawlability", 4, 2, "Internal links point at non-canonical URLs", "links_noncanonical >= 3 and links_noncanonical >= 0.15 * linked_sample"),
    (S, "HIGH", "crawlability", 5, 3, "Canonical points at a thinner page than the one carrying it", "thinner_targets > 0"),
    (S, "=if(links_noindex >= 0.4 * linked_sample, 'MEDIUM', 'LOW')", "crawlability", 3, 2, "=concat('Internal links lead to noindexed pages (', links_noindex, ' of ', linked_sample, ' sampled)')", "links_noindex >= 5 or (linked_sample >= 10 and links_noindex >= 0.25 * linked_sample)"),
    (S, "MEDIUM", "crawlability", 4, 3, "A sitemap template gets no internal links from any crawled page", "orphan_templates > 0 and pages >= 8 and sitemap_urls <= 40 * pages"),
    (S, "LOW", "crawlability", 2, 1, "HEAD requests fail where GET succeeds", "head_failures > 0"),
    (S, "LOW", "trust", 2, 1, "Self-declared review counts disagree across pages", "rating_conflicts > 0"),
    (S, "=if(affiliate_pages >= 0.5 * analysed, 'MEDIUM', 'LOW')", "on page", 4, 3, "Large share of pages carry affiliate links", "analysed >= 20 and affiliate_pages >= 0.3 * analysed"),
    (S, "=if(owned_sites >= 2 or owned_shared > 0, 'MEDIUM', 'LOW')", "crawlability", 4, 3, "Other domains owned by this business are separate live sites", "owned_sites > 0"),
    (S, "LOW", "schema", 2, 2, "No BreadcrumbList schema on any crawled page", "deep_pages >= 3 and any_text and max_depth >= 2 and not any_breadcrumb"),
    (S, "LOW", "on page", 2, 1, "Most meta descriptions lack a call to action", "descriptions >= 3 and descriptions_no_cta * 2 > descriptions"),
    (S, "HIGH", "trust", 5, 1, "Domain registration expires within 30 days", "domain_days <= 30"),
    (S, "MEDIUM", "trust", 4, 1, "Domain registration expires within 60 days", "domain_days between 31 and 60"),
    (S, "MEDIUM", "trust", 3, 1, "Published contact address uses a domain that cannot receive mail", "contact_dead > 0"),
    (S, "LOW", "trust", 2, 1, "DMARC policy has no reporting address", "dmarc and not dmarc_reports"),
    (S, "LOW", "trust", 2, 1, "=concat('Sending domain lacks ', missing_mail_auth)", "missing_mail_auth <> ''"),
    (S, "LOW", "trust", 1, 1, "security.txt has expired", "security_txt and security_expires < today"),
    (S, "LOW", "trust", 1, 1, "security.txt has no Expires field", "security_txt and security_expires is null"),
    (S, "CRITICAL", "trust", 5, 1, "Private files are publicly downloadable", "exposed_files > 0"),
    (S, "LOW", "trust", 2, 1, "No postal address found anywhere on the crawled pages", "not postal_found and trust_seen"),
    (S, "INFO", "ai search", 2, 1, "llms.txt lists URLs that don't resolve", "llms_status = 200 and llms_dead > 0"),
    (S, "INFO", "ai search", 2, 1, "llms.txt points at non-canonical URLs", "llms_status = 200 and llms_noncanonical > 0"),
    (S, "INFO", "ai search", 1, 1, "llms.txt deviates from the llmstxt.org format", "llms_status = 200 and not llms_format"),
    (S, "MEDIUM", "on page", 3, 3, "Near-duplicate pages within a template", "near_pairs > 0"),
    (S, "LOW", "on page", 3, 3, "Template pages are mostly boilerplate", "near_pairs = 0 and median_unique < 120"),
    (S, "MEDIUM", "social", 3, 2, "=concat('Aspect ratio ', format_number(og_ratio, 2), ':1 differs from the 1.91:1 social standard')", "abs(og_ratio - 1.91) / 1.91 > 0.15"),
    (S, "LOW", "social", 2, 1, "Share image is over 600 KB", "og_bytes > 614400"),
    (S, "MEDIUM", "social", 3, 2, "No Open Graph image", "not og_image"),
    (S, "LOW", "social", 2, 2, "<head> ends beyond the first 300 KB of HTML", "head_bytes > 307200"),
    (S, "LOW", "social", 2, 1, "Missing twitter:card", "not twitter_card"),
    (S, "LOW", "social", 2, 1, "Missing Open Graph title", "not og_title"),
    (S, "LOW", "social", 2, 1, "Open Graph tags incomplete", "og_title and og_image and not og_complete"),
    (S, "LOW", "social", 1, 1, "=concat('Favicon is ', favicon_bytes div 1024, ' KB')", "favicon_bytes > 102400"),
    (S, "LOW", "social", 1, 1, "No call-to-action verb in title or description", "not title_cta and not description_cta"),
    (S, "INFO", "performance", 1, 1, "PageSpeed Insights rate-limited", "psi_status = 429"),
    (S, "INFO", "performance", 1, 1, "PageSpeed Insights unavailable", "psi_invalid or (psi_status >= 400 and psi_status <> 429)"),
    (S, "HIGH", "performance", 4, 4, "Poor PageSpeed performance score", "psi_score < 50"),
    (S, "MEDIUM", "performance", 3, 3, "PageSpeed performance below 90", "psi_score between 50 and 89"),
    (S, "CRITICAL", "crawlability", 5, 2, "robots.txt returns a server error", "robots_status >= 500"),
    (S, "HIGH", "crawlability", 4, 1, "robots.txt is an HTML page", "robots_status = 200 and robots_html"),
    (S, "MEDIUM", "crawlability", 3, 1, "robots.txt not found", "robots_status < 500 and not coalesce(robots_html, false) and not robots_found"),
    (S, "LOW", "crawlability", 2, 1, "Sitemap not referenced in robots.txt", "robots_found and sitemap_found and robots_sitemaps = 0"),
    (S, "MEDIUM", "crawlability", 3, 2, "XML sitemap not found", "not sitemap_found"),
    (S, "MEDIUM", "crawlability", 3, 2, "Sitemap contains no URLs", "sitemap_found and sitemap_urls = 0"),
    (S, "CRITICAL", "crawlability", 5, 1, "robots.txt blocks all crawlers", "blocks_all"),
    (S, "MEDIUM", "crawlability", 3, 2, "robots.txt exceeds 500 KiB", "robots_bytes > 512000"),
    (S, "MEDIUM", "ai search", 4, 1, "robots.txt blocks AI search crawlers", "ai_blocked_search > 0"),
    (S, "LOW", "ai search", 2, 1, "robots.txt blocks AI training crawlers", "coalesce(ai_blocked_search, 0) = 0 and ai_blocked_train > 0"),
    (S, "CRITICAL", "crawlability", 5, 2, "The homepage does not load", "home_status >= 400"),
    (S, "LOW", "crawlability", 2, 1, "=concat('Sitemap lists redirecting URLs (', sm_redirects, ')')", "sm_redirects >= 2"),
    (S, "=if(sm_dead >= greatest(2, 0.1 * sm_checked), 'HIGH', 'MEDIUM')", "crawlability", 4, 1, "=concat('Sitemap lists URLs that return errors (', sm_dead, ' of ', sm_checked, ' checked)')", "sm_dead > 0"),
    (S, "MEDIUM", "crawlability", 3, 1, "=concat('Sitemap lists noindexed URLs (', sm_noindex, ' of ', sm_checked, ' checked)')", "sm_noindex > 0"),
    (S, "MEDIUM", "crawlability", 3, 1, "=concat('Sitemap lists non-canonical URLs (', sm_noncanonical, ' of ', sm_checked, ' checked)')", "sm_noncanonical >= 2"),
    (S, "INFO", "crawlability", 2, 2, "Site refuses non-browser user-agents", "refused_pages > 0"),
    (S, "=if(small_imgs >= 12, 'MEDIUM', 'LOW')", "performance", 3, 2, "Small images are served from large files", "small_checked >= 3 and small_heavy >= greatest(2, small_checked div 2)"),
    (S, "LOW", "schema", 3, 2, "No Organization/WebSite schema on homepage", "not org_schema"),
    (S, "LOW", "schema", 2, 1, "LocalBusiness schema incomplete", "local_schema and not local_complete"),
    (S, "MEDIUM", "schema", 3, 2, "No LocalBusiness schema for a local business", "not local_schema and local_signals"),
)


def _sql(text: str) -> Column:
    return F.expr(text[1:]) if text.startswith("=") else F.lit(text)


def with_facts(df: DataFrame, facts: dict[str, str]) -> DataFrame:
    """``df`` with a typed null for each fact that it lacks."""
    missing = {name: F.lit(None).cast(kind) for kind, names in facts.items() for name in names.split() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def findings(df: DataFrame, scope: str, keys: list[str]) -> DataFrame:
    """A row for each rule of the scope that holds: keys, severity, category, impact, effort, title, rule."""
    full = with_facts(df, PAGE_FACTS if scope == P else SITE_FACTS)
    fired = []
    for i, (s, severity, category, impact, effort, title, predicate) in enumerate(RULES):
        if s == scope:
            one = F.struct(F.lit(i).alias("rule"), _sql(severity).alias("severity"), F.lit(category).alias("category"), F.lit(impact).alias("impact"), F.lit(effort).alias("effort"), _sql(title).alias("title"))
            fired.append(F.when(F.expr(predicate), one))
    # An unreachable page has no other findings.
    hit = F.filter(F.array(*fired), lambda x: x.isNotNull())
    if scope == P:
        hit = F.when(F.expr(RULES[0][6]), F.slice(hit, 1, 1)).otherwise(hit)
    return full.select(*keys, F.explode(hit).alias("_r")).select(*keys, "_r.*")
