"""Signatures of trackers, platforms and services. Data, not logic: to watch for a tool is to add a row.

Fixed values throughout: patterns match without regard to case, id patterns with it.
"""

from __future__ import annotations

#: key, name, category, patterns, id patterns
TRACKERS = [
    ("gtm", "Google Tag Manager", "tag_manager", [r"googletagmanager\.com/gtm\.js", r"\bGTM-[A-Z0-9]{4,}"], [r"\b(GTM-[A-Z0-9]{4,10})\b"]),
    ("adobe_launch", "Adobe Launch / DTM", "tag_manager", [r"assets\.adobedtm\.com"], []),
    ("tealium", "Tealium iQ", "tag_manager", [r"tags\.tiqcdn\.com"], []),
    ("ga4", "Google Analytics 4", "analytics", [r"googletagmanager\.com/gtag/js\?id=G-", r"\bG-[A-Z0-9]{6,12}\b", r"google-analytics\.com/g/collect", r"analytics\.google\.com/g/collect", r"gtag\(\s*[\"']config[\"']\s*,\s*[\"']G-", r"\"measurementId\"\s*:\s*\"G-"], [r"\b(G-[A-Z0-9]{6,12})\b"]),
    ("ua", "Universal Analytics", "analytics", [r"\bUA-\d{4,10}-\d{1,3}\b", r"google-analytics\.com/analytics\.js", r"gtag\(\s*[\"']config[\"']\s*,\s*[\"']UA-"], [r"\b(UA-\d{4,10}-\d{1,3})\b"]),
    ("clarity", "Microsoft Clarity", "session_recording", [r"clarity\.ms/tag/", r"\bclarity\s*\(\s*[\"']set"], [r"clarity\.ms/tag/([a-z0-9]{6,})"]),
    ("hotjar", "Hotjar", "session_recording", [r"static\.hotjar\.com", r"\bhjid\s*[:=]\s*\d+"], [r"hjid\s*[:=]\s*(\d{5,9})"]),
    ("matomo", "Matomo / Piwik", "analytics", [r"matomo\.js", r"piwik\.js", r"_paq\.push"], []),
    ("plausible", "Plausible Analytics", "analytics", [r"plausible\.io/js"], []),
    ("fathom", "Fathom Analytics", "analytics", [r"usefathom\.com"], []),
    ("heap", "Heap", "analytics", [r"heap-\d+\.js", r"cdn\.heapanalytics\.com", r"heap\.load\("], [r"heap\.load\(\s*[\"'](\d+)"]),
    ("mixpanel", "Mixpanel", "analytics", [r"cdn\.mxpnl\.com", r"mixpanel\.init"], []),
    ("amplitude", "Amplitude", "analytics", [r"cdn\.amplitude\.com", r"amplitude\.getInstance"], []),
    ("segment", "Segment", "analytics", [r"cdn\.segment\.com/analytics\.js"], []),
    ("adobe_analytics", "Adobe Analytics", "analytics", [r"\.omtrdc\.net", r"\bs_code\.js", r"AppMeasurement"], []),
    ("cf_insights", "Cloudflare Web Analytics", "analytics", [r"static\.cloudflareinsights\.com/beacon"], []),
    ("yandex_metrica", "Yandex Metrica", "analytics", [r"mc\.yandex\.ru/metrika"], []),
    ("google_ads", "Google Ads (conversion / remarketing)", "advertising", [r"\bAW-\d{9,11}\b", r"googleadservices\.com/pagead/conversion"], [r"\b(AW-\d{9,11})\b"]),
    ("floodlight", "Google Floodlight (DoubleClick)", "advertising", [r"\bDC-\d{6,9}\b", r"fls\.doubleclick\.net"], [r"\b(DC-\d{6,9})\b"]),
    ("meta_pixel", "Meta Pixel (Facebook)", "advertising", [r"connect\.facebook\.net/[^\"']*fbevents\.js", r"\bfbq\s*\(", r"facebook\.com/tr\?"], [r"fbq\s*\(\s*[\"']init[\"']\s*,\s*[\"'](\d{8,20})", r"facebook\.com/tr\?id=(\d{8,20})", r"\"pixelId\"\s*:\s*\"(\d{8,20})\""]),
    ("linkedin", "LinkedIn Insight Tag", "advertising", [r"snap\.licdn\.com", r"_linkedin_partner_id", r"px\.ads\.linkedin\.com"], [r"_linkedin_partner_id\s*=\s*[\"'](\d{5,9})"]),
    ("tiktok", "TikTok Pixel", "advertising", [r"analytics\.tiktok\.com", r"\bttq\.load\("], [r"ttq\.load\(\s*[\"']([A-Z0-9]{10,});?[\"']", r"sdkid=([A-Z0-9]{10,})"]),
    ("pinterest", "Pinterest Tag", "advertising", [r"s\.pinimg\.com/ct/core\.js", r"\bpintrk\s*\(", r"ct\.pinterest\.com"], [r"pintrk\(\s*[\"']load[\"']\s*,\s*[\"'](\d{10,16})"]),
    ("twitter", "X / Twitter Pixel", "advertising", [r"static\.ads-twitter\.com/uwt\.js", r"\btwq\s*\(", r"t\.co/i/adsct"], [r"twq\(\s*[\"'](?:config|init)[\"']\s*,\s*[\"']([a-z0-9]{5,8})"]),
    ("snapchat", "Snap Pixel", "advertising", [r"sc-static\.net/scevent", r"\bsnaptr\s*\("], [r"snaptr\(\s*['\"]init['\"]\s*,\s*['\"]([a-f0-9-]{36})"]),
    ("reddit", "Reddit Pixel", "advertising", [r"redditstatic\.com/ads/pixel\.js", r"\brdt\s*\("], [r"rdt\(\s*['\"]init['\"]\s*,\s*['\"](t2?_[a-z0-9]+)"]),
    ("bing_uet", "Microsoft Ads UET (Bing)", "advertising", [r"bat\.bing\.com/bat\.js", r"\buetq\b"], [r"\"ti\"\s*:\s*\"?(\d{7,9})", r"ti:\s*[\"'](\d{7,9})"]),
    ("criteo", "Criteo", "advertising", [r"static\.criteo\.net"], []),
    ("taboola", "Taboola", "advertising", [r"cdn\.taboola\.com"], []),
    ("outbrain", "Outbrain", "advertising", [r"outbrain\.com/outrank", r"amplify\.outbrain\.com"], []),
    ("amazon_ads", "Amazon Ads", "advertising", [r"amazon-adsystem\.com"], []),
    ("adroll", "AdRoll", "advertising", [r"s\.adroll\.com"], []),
    ("gads_syndication", "Google AdSense", "advertising", [r"pagead2\.googlesyndication\.com/pagead/js/adsbygoogle"], [r"(ca-pub-\d{10,20})"]),
    ("fullstory", "FullStory", "session_recording", [r"fullstory\.com/s/fs\.js", r"\b_fs_org\b"], []),
    ("luckyorange", "Lucky Orange", "session_recording", [r"luckyorange\.com"], []),
    ("mouseflow", "Mouseflow", "session_recording", [r"cdn\.mouseflow\.com"], []),
    ("smartlook", "Smartlook", "session_recording", [r"web-sdk\.smartlook\.com", r"rec\.smartlook\.com"], []),
    ("inspectlet", "Inspectlet", "session_recording", [r"cdn\.inspectlet\.com"], []),
    ("crazyegg", "Crazy Egg", "session_recording", [r"script\.crazyegg\.com"], []),
    ("vwo", "VWO (Visual Website Optimizer)", "session_recording", [r"dev\.visualwebsiteoptimizer\.com"], []),
    ("optimizely", "Optimizely", "session_recording", [r"cdn\.optimizely\.com"], []),
    ("intercom", "Intercom", "chat", [r"widget\.intercom\.io", r"\bIntercom\(", r"intercomSettings"], [r"app_id\s*[:=]\s*[\"']([a-z0-9]{6,12})"]),
    ("drift", "Drift", "chat", [r"js\.driftt\.com"], []),
    ("zendesk", "Zendesk (chat/widget)", "chat", [r"static\.zdassets\.com", r"zopim"], []),
    ("tawk", "Tawk.to", "chat", [r"embed\.tawk\.to"], [r"embed\.tawk\.to/([a-f0-9]{15,32})"]),
    ("crisp", "Crisp Chat", "chat", [r"client\.crisp\.chat", r"CRISP_WEBSITE_ID"], [r"CRISP_WEBSITE_ID\s*=\s*[\"']([a-f0-9-]{36})"]),
    ("livechat", "LiveChat", "chat", [r"cdn\.livechatinc\.com"], []),
    ("tidio", "Tidio", "chat", [r"code\.tidio\.co"], []),
    ("fb_chat", "Messenger Customer Chat", "chat", [r"xfbml\.customerchat"], []),
    ("hubspot", "HubSpot", "email_marketing", [r"js\.hs-scripts\.com", r"js\.hsforms\.net", r"track\.hubspot\.com"], [r"js\.hs-scripts\.com/(\d{6,9})\.js"]),
    ("klaviyo", "Klaviyo", "email_marketing", [r"static\.klaviyo\.com", r"klaviyo\.js"], [r"company_id=([A-Za-z0-9]{6})"]),
    ("mailchimp", "Mailchimp", "email_marketing", [r"chimpstatic\.com", r"list-manage\.com", r"mcjs"], []),
    ("activecampaign", "ActiveCampaign", "email_marketing", [r"trackcmp\.net", r"activehosted\.com"], []),
    ("pardot", "Salesforce Account Engagement (Pardot)", "email_marketing", [r"pi\.pardot\.com", r"pardot\.com/pd\.js"], []),
    ("marketo", "Marketo (Munchkin)", "email_marketing", [r"munchkin\.js", r"mktoresp", r"marketo\.com"], []),
    ("brevo", "Brevo (Sendinblue)", "email_marketing", [r"sibautomation\.com", r"sendinblue\.com/js"], []),
    ("omnisend", "Omnisend", "email_marketing", [r"omnisnippet", r"omnisend\.com"], []),
    ("convertkit", "Kit (ConvertKit)", "email_marketing", [r"convertkit\.com", r"ck\.page"], []),
    ("campaignmonitor", "Campaign Monitor", "email_marketing", [r"createsend1?\.com"], []),
    ("callrail", "CallRail", "call_tracking", [r"cdn\.callrail\.com", r"callrail\.com/companies"], []),
    ("whatconverts", "WhatConverts", "call_tracking", [r"scripts\.iconnode\.com", r"whatconverts"], []),
    ("ctm", "CallTrackingMetrics", "call_tracking", [r"tctm\.co/t\.js", r"calltrackingmetrics"], []),
    ("delacon", "Delacon (AU call tracking)", "call_tracking", [r"plavxml\.com", r"delaconcorp"], []),
    ("wildjar", "WildJar (AU call tracking)", "call_tracking", [r"wildjar\.com", r"t\.wldjr\.com"], []),
    ("cookiebot", "Cookiebot", "consent", [r"consent\.cookiebot\.com"], []),
    ("onetrust", "OneTrust", "consent", [r"cdn\.cookielaw\.org", r"onetrust"], []),
    ("cookieyes", "CookieYes", "consent", [r"cdn-cookieyes\.com"], []),
    ("complianz", "Complianz (WP)", "consent", [r"complianz", r"cmplz"], []),
    ("termly", "Termly", "consent", [r"app\.termly\.io"], []),
    ("recaptcha", "Google reCAPTCHA", "security", [r"google\.com/recaptcha", r"gstatic\.com/recaptcha"], []),
    ("hcaptcha", "hCaptcha", "security", [r"hcaptcha\.com/1/api\.js"], []),
    ("trustpilot", "Trustpilot widget", "widget", [r"widget\.trustpilot\.com"], []),
    ("elfsight", "Elfsight widgets", "widget", [r"apps\.elfsight\.com", r"elfsightcdn\.com"], []),
    ("judgeme", "Judge.me reviews", "widget", [r"cdn\.judge\.me"], []),
    ("yotpo", "Yotpo reviews", "widget", [r"staticw2\.yotpo\.com", r"yotpo\.com"], []),
    ("gmaps_embed", "Google Maps embed", "widget", [r"google\.com/maps/embed", r"maps\.googleapis\.com/maps/api"], []),
    ("calendly", "Calendly", "widget", [r"assets\.calendly\.com"], []),
    ("stripe", "Stripe", "payments", [r"js\.stripe\.com"], []),
    ("paypal", "PayPal", "payments", [r"paypal\.com/sdk/js", r"paypalobjects\.com"], []),
    ("afterpay", "Afterpay", "payments", [r"portal\.afterpay\.com", r"afterpay\.js"], []),
]
#: Tags that no longer collect anything, and since when.
DEAD = {"ua": "2023-07-01"}
CATEGORIES = ["tag_manager", "analytics", "advertising", "session_recording", "chat", "email_marketing", "call_tracking", "consent", "verification", "widget", "security", "payments"]
VERIFICATIONS = [
    ("google-site-verification", "Google Search Console"), ("facebook-domain-verification", "Meta Business Manager"), ("msvalidate.01", "Bing Webmaster Tools"),
    ("p:domain_verify", "Pinterest"), ("yandex-verification", "Yandex Webmaster"), ("baidu-site-verification", "Baidu Webmaster"),
    ("ahrefs-site-verification", "Ahrefs Webmaster Tools"), ("wot-verification", "WOT"), ("norton-safeweb-site-verification", "Norton Safe Web"),
]
SOCIALS = {
    "facebook.com": "Facebook", "instagram.com": "Instagram", "linkedin.com": "LinkedIn", "x.com": "X (Twitter)", "twitter.com": "X (Twitter)", "youtube.com": "YouTube", "tiktok.com": "TikTok",
    "pinterest.com": "Pinterest", "pinterest.com.au": "Pinterest", "threads.net": "Threads", "threads.com": "Threads", "wa.me": "WhatsApp", "api.whatsapp.com": "WhatsApp", "snapchat.com": "Snapchat",
    "medium.com": "Medium", "github.com": "GitHub", "vimeo.com": "Vimeo", "behance.net": "Behance", "dribbble.com": "Dribbble", "houzz.com.au": "Houzz", "houzz.com": "Houzz",
}
#: Addresses on social hosts that are no profile.
NO_PROFILE = r"/sharer|/share\b|share\?|/intent/|/plugins/|/dialog/|/hashtag/|facebook\.com/tr\b|/login|\.js\b|/embed/"
SECURITY_HEADERS = [
    ("strict-transport-security", "HSTS"), ("content-security-policy", "CSP"), ("x-content-type-options", "X-Content-Type-Options"),
    ("x-frame-options", "X-Frame-Options"), ("referrer-policy", "Referrer-Policy"), ("permissions-policy", "Permissions-Policy"),
]
#: pattern, name, whether case counts; the first that matches is the platform
PLATFORMS = [
    (r"/wp-content/|/wp-includes/|wp-json", "WordPress", False),
    (r"cdn\.shopify\.com|myshopify\.com", "Shopify", False),
    (r"static\.parastorage\.com|wixstatic\.com|wix\.com", "Wix", False),
    (r"squarespace\.com|static1\.squarespace", "Squarespace", False),
    (r"assets(?:-global)?\.website-files\.com|data-wf-site", "Webflow", False),
    (r"cdn\.dudamobile\.com|dudaone|_duda_", "Duda", False),
    (r"bigcommerce\.com|cdn\d+\.bigcommerce", "BigCommerce", False),
    (r"/static/version\d+/frontend/|Mage\.Cookies|mage-init|data-mage-init|/mage/|\"Magento_|x-magento", "Magento (Adobe Commerce)", True),
    (r"framerusercontent\.com", "Framer", False),
]
WORDPRESS_THEME, SHOPIFY_THEME = r"/wp-content/themes/([a-zA-Z0-9_-]+)/", r'"name":"([^"]+)","theme_store_id"'
WORDPRESS_DETAILS = [
    (r"elementor", "Builder: Elementor"),
    (r'et_pb_|/themes/Divi/|et-core|et_divi|id="et-boc|class="et_pb', "Builder: Divi"),
    (r"fl-builder", "Builder: Beaver Builder"),
    (r"wpbakery|js_composer", "Builder: WPBakery"),
    (r"oxygen[_-]", "Builder: Oxygen"),
    (r"bricks[/-]", "Builder: Bricks"),
    (r"This site is optimized with the Yoast|yoast-schema-graph", "SEO plugin: Yoast"),
    (r"Rank Math", "SEO plugin: RankMath"),
    (r"seopress", "SEO plugin: SEOPress"),
    (r"aioseo", "SEO plugin: All in One SEO"),
    (r"WP Rocket", "Cache: WP Rocket"),
    (r"litespeed-cache|LiteSpeed Cache", "Cache: LiteSpeed"),
    (r"w3tc|W3 Total Cache", "Cache: W3 Total Cache"),
    (r"wp-optimize", "Cache: WP-Optimize"),
    (r"woocommerce", "WooCommerce store"),
    (r"wpml|polylang", "Multilingual plugin"),
    (r"gravityforms|gform", "Forms: Gravity Forms"),
    (r"wpforms", "Forms: WPForms"),
    (r"contact-form-7|wpcf7", "Forms: Contact Form 7"),
]
FRAMEWORKS = [
    (r"__NEXT_DATA__|/_next/", "Next.js"), (r"__NUXT__|/_nuxt/", "Nuxt"), (r"___gatsby", "Gatsby"), (r"data-reactroot|react-dom", "React"), (r"\bng-version=", "Angular"),
    (r"data-v-app|__vue", "Vue"), (r"astro-island|astro/client", "Astro"), (r"data-svelte", "Svelte"), (r"livewire", "Laravel Livewire"),
]
