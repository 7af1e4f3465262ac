"""Views that give the benchmark tables the shape of prospecting inputs.

Each view is one SELECT in the SQL that Spark and DuckDB share; ``@name@`` stands
for a table or another view. Attributes the tables lack are derived from keys with
``%`` and ``CASE``, so both engines see the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from leadloom.session import prepare

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

REGISTER_AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-31 00:00:00"

VIEWS: dict[str, str] = {}

VIEWS["companies_v"] = """
SELECT lpad(cast(c_custkey AS string), 8, '0') AS company_number,
       concat(c_name, CASE c_custkey % 4 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Limited'
              WHEN 2 THEN ' & Sons PLC' ELSE ' LLP' END) AS company_name,
       CASE WHEN c_custkey % 23 = 0 THEN 'dissolved' ELSE 'active' END AS company_status,
       CASE WHEN c_custkey % 4 = 2 THEN 'plc' ELSE 'ltd' END AS company_type,
       date '1960-01-01' + cast((c_custkey * 37) % 14000 AS int) AS date_of_creation,
       CASE WHEN c_custkey % 31 = 0 THEN 'Kemp House, 152-160 City Road'
            ELSE concat(cast(c_custkey % 40 AS string), ' High Street') END AS address_line_1,
       CASE WHEN c_custkey % 40 < 10 THEN 'Floor 2' WHEN c_custkey % 40 < 20 THEN '' END
         AS address_line_2,
       n_name AS locality,
       CASE WHEN n_nationkey % 5 = 0 THEN NULL
            ELSE concat('Region ', cast(n_regionkey AS string)) END AS region,
       CASE WHEN c_custkey % 40 = 17 THEN NULL
            ELSE concat('ls', cast(c_custkey % 40 + 1 AS string), ' ',
                        cast(c_custkey % 8 + 1 AS string), 'AB') END AS postal_code,
       CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'United Kingdom' END AS country,
       CASE c_custkey % 5 WHEN 0 THEN '62012,62020' WHEN 1 THEN '70229'
            WHEN 2 THEN '64209,70100' WHEN 3 THEN '41100' END AS sic_csv,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'small' WHEN 'BUILDING' THEN 'Full '
            WHEN 'FURNITURE' THEN 'micro-entity' WHEN 'HOUSEHOLD' THEN 'audited-abridged'
       END AS accounts_category,
       CASE WHEN c_custkey % 13 = 0 THEN NULL
            ELSE date '2001-06-01' + cast((c_custkey * 13) % 200 AS int) END AS accounts_next_due,
       c_custkey % 19 = 0 AS accounts_overdue,
       CASE WHEN c_custkey % 29 = 0 THEN 'DORMANT' WHEN c_custkey % 43 = 0 THEN 'aa02'
            WHEN c_custkey % 47 = 0 THEN 'micro_dormant' WHEN c_custkey % 53 = 0 THEN NULL
            WHEN c_custkey % 59 = 0 THEN 'DORMANT_OTHER'
            ELSE 'TOTAL-EXEMPTION-FULL' END AS last_accounts_type,
       CASE WHEN c_custkey % 37 = 0 THEN NULL
            ELSE date '2000-01-31' + cast((c_custkey * 7) % 366 AS int) END AS last_made_up_to,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 41 = 0 END AS confirmation_overdue,
       date '2001-07-01' + cast(c_custkey % 300 AS int) AS confirmation_next_due,
       c_custkey % 61 = 0 AS has_been_liquidated,
       c_custkey % 67 = 0 AS has_insolvency_history
FROM @customer@ JOIN @nation@ ON c_nationkey = n_nationkey
"""

VIEWS["officers_v"] = """
SELECT lpad(cast(o_custkey AS string), 8, '0') AS company_number,
       concat('Director  Nr', cast(l_suppkey AS string)) AS name,
       CASE (l_suppkey + l_linenumber) % 8 WHEN 0 THEN 'director' WHEN 1 THEN 'llp-member'
            WHEN 2 THEN 'director' WHEN 3 THEN 'secretary' ELSE 'judicial-factor' END
         AS officer_role,
       min(CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE cast(l_shipdate AS date) END)
         AS appointed_on,
       min(CASE WHEN l_returnflag = 'R' THEN cast(l_shipdate AS date) + 400
                WHEN l_returnflag = 'A' THEN cast(l_shipdate AS date) + 200 END) AS resigned_on,
       min(CASE WHEN l_suppkey % 4 = 0 THEN 'Engineer' WHEN l_suppkey % 4 = 1 THEN 'Solicitor'
           END) AS occupation,
       min(CASE WHEN l_suppkey % 5 = 0 THEN 'Irish' ELSE 'British' END) AS nationality,
       min(CASE WHEN l_suppkey % 6 = 0 THEN 'Ireland' ELSE 'England' END)
         AS country_of_residence,
       cast(CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_suppkey % 12 + 1 END AS int)
         AS dob_month,
       cast(CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 1950 + l_suppkey % 45 END AS int)
         AS dob_year
FROM @lineitem@ JOIN @orders@ ON l_orderkey = o_orderkey
GROUP BY o_custkey, l_suppkey, (l_suppkey + l_linenumber) % 8
"""

VIEWS["filings_v"] = """
SELECT lpad(cast(o_custkey AS string), 8, '0') AS company_number,
       o_orderkey AS filing_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'accounts' WHEN '2-HIGH' THEN 'capital'
            WHEN '3-MEDIUM' THEN 'address' WHEN '4-NOT SPECIFIED' THEN 'change-of-name'
            ELSE 'other' END AS category,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS filing_date,
       CASE o_orderkey % 6 WHEN 0 THEN 'Change of registered office address'
            WHEN 1 THEN 'Statement of share allotment' WHEN 2 THEN 'increase in nominal capital'
            WHEN 3 THEN NULL ELSE 'confirmation statement' END AS description,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 10 <> 9
            THEN concat('/document/D', cast(o_orderkey AS string), '/content?v=1') END
         AS document_link
FROM @orders@
"""

VIEWS["charges_v"] = """
SELECT lpad(cast(o_custkey AS string), 8, '0') AS company_number,
       CASE WHEN o_totalprice <= 300000 THEN 'satisfied' WHEN o_orderstatus = 'O' THEN 'outstanding'
            WHEN o_orderstatus = 'P' THEN 'part-satisfied' ELSE 'satisfied' END AS status,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS created_on
FROM @orders@
"""

VIEWS["psc_v"] = """
SELECT lpad(cast(o_custkey AS string), 8, '0') AS company_number,
       concat('Owner ', cast(l_suppkey AS string)) AS name,
       CASE l_suppkey % 4 WHEN 0 THEN 'Corporate-entity-person-with-significant-control'
            WHEN 1 THEN 'legal-person-person-with-significant-control' WHEN 2 THEN NULL
            ELSE 'individual-person-with-significant-control' END AS kind,
       CASE WHEN l_returnflag = 'A' OR l_quantity < 40 THEN cast(l_shipdate AS date) END
         AS ceased_on
FROM @lineitem@ JOIN @orders@ ON l_orderkey = o_orderkey
"""

VIEWS["accounts_history_v"] = """
SELECT lpad(cast(o_custkey AS string), 8, '0') AS company_number,
       cast(year(o_orderdate) AS int) AS period_year,
       cast(floor(sum(cast(round(o_totalprice * 100) AS bigint)) / 100.0) AS bigint)
         * (1 + o_custkey % 40) AS turnover,
       cast(count(*) * (1 + o_custkey % 60) AS int) AS employees
FROM @orders@ GROUP BY o_custkey, year(o_orderdate)
"""

VIEWS["accounts_v"] = """
SELECT c.company_number,
       CASE WHEN c.company_number LIKE '%7' THEN NULL ELSE h.turnover END AS turnover,
       p.turnover AS prior_turnover,
       CASE WHEN c.company_number LIKE '%3' THEN NULL ELSE h.employees END AS employees,
       p.employees AS prior_employees,
       date '2000-12-31' AS made_up_to
FROM @companies_v@ c
JOIN @accounts_history_v@ h ON h.company_number = c.company_number AND h.period_year = 2000
LEFT JOIN @accounts_history_v@ p ON p.company_number = c.company_number AND p.period_year = 1999
"""

VIEWS["accounts_docs_v"] = """
SELECT company_number, filing_date, document_id,
  CASE WHEN n % 23 = 0 THEN 'application/pdf' ELSE 'application/xhtml+xml' END AS content_type,
  CASE WHEN n % 19 = 0 THEN '<html>short</html>' ELSE concat(
    '<html><body>', repeat('<p>Notes to the financial statements.</p>', 30),
    CASE WHEN n % 11 = 0 THEN '' ELSE concat(
      '<xbrli:context id="cur"><xbrli:period><xbrli:startDate>2000-01-01</xbrli:startDate>',
      '<xbrli:endDate>2000-12-31</xbrli:endDate></xbrli:period></xbrli:context>',
      CASE WHEN n % 7 = 0 THEN '' ELSE concat(
        '<xbrli:context id="pri"><xbrli:period><xbrli:instant>1999-12-',
        CASE WHEN n % 3 = 0 THEN '30' ELSE '31' END,
        '</xbrli:instant></xbrli:period></xbrli:context>') END,
      '<xbrli:context id="old"><xbrli:period><xbrli:endDate>1990-12-31</xbrli:endDate>',
      '</xbrli:period></xbrli:context>') END,
    CASE WHEN n % 17 = 0 THEN '' ELSE concat(
      '<ix:nonFraction name="core:', CASE WHEN n % 4 = 0 THEN 'TurnoverRevenue' ELSE 'Turnover' END,
      '" contextRef="old" unitRef="GBP">999</ix:nonFraction>',
      CASE WHEN n % 13 = 0 THEN '' ELSE concat(
        '<ix:nonFraction name="core:Turnover"',
        CASE WHEN n % 5 = 0 THEN '' ELSE ' contextRef="cur"' END,
        CASE WHEN n % 4 = 1 THEN ' scale="3"' ELSE '' END, '>',
        '<span>£', cast(n % 900 + 1 AS string), ',', lpad(cast(n % 1000 AS string), 3, '0'),
        '</span></ix:nonFraction>') END,
      '<ix:nonFraction name="core:Turnover" contextRef="pri">',
      cast(n * 3 % 100000 AS string), '.5</ix:nonFraction>',
      '<ix:nonFraction name="uk:AverageNumberEmployeesDuringPeriod" contextRef="cur"',
      CASE WHEN n % 9 = 0 THEN ' sign="-"' ELSE '' END, '>', cast(n % 250 AS string),
      '</ix:nonFraction>',
      '<ix:nonFraction name="uk:AverageNumberEmployees" contextRef="pri">',
      cast(n % 240 AS string), '</ix:nonFraction>',
      '<ix:nonFraction name="core:ProfitLoss" contextRef="cur">(',
      cast(n % 5000 AS string), ')</ix:nonFraction>') END,
    '</body></html>') END AS html
FROM (SELECT company_number, filing_date, filing_id AS n,
             concat('D', cast(filing_id AS string)) AS document_id
      FROM @filings_v@ WHERE document_link IS NOT NULL) d
"""

VIEWS["leads_v"] = """
SELECT lpad(cast(p_partkey AS string), 8, '0') AS id,
  concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE ' + ' END, p_brand,
         CASE p_partkey % 5 WHEN 1 THEN ' Ltd' WHEN 2 THEN ' Limited' WHEN 3 THEN ' & Co.'
              WHEN 4 THEN ' PLC' ELSE '' END) AS business_name,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS city,
  concat(cast(p_partkey % 90 AS string), ' Mill Lane, Leeds') AS address,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE concat('LS', cast(p_size AS string)) END
    AS outward_postcode,
  CASE WHEN p_partkey % 13 = 0 THEN concat('https://www.shared', cast(cast(floor(p_partkey / 26.0) AS bigint) AS string), '.co.uk/')
       WHEN p_partkey % 4 = 0 THEN concat('shop.site', cast(p_partkey AS string), '.com/home') END
    AS website_url,
  CASE WHEN p_partkey % 17 = 0 THEN concat('Info+x@box', cast(cast(floor(p_partkey / 34.0) AS bigint) AS string), '.com')
       WHEN p_partkey % 19 = 0 THEN concat('a.b', cast(cast(floor(p_partkey / 38.0) AS bigint) AS string), '@googlemail.com')
       WHEN p_partkey % 3 = 0 THEN concat('owner', cast(p_partkey AS string), '@mail.com') END
    AS email,
  CASE WHEN p_partkey % 23 = 0 THEN concat('0113 ', lpad(cast(cast(floor(p_partkey / 46.0) AS bigint) AS string), 7, '0'))
       WHEN p_partkey % 5 = 0 THEN concat('+44 20 ', lpad(cast(p_partkey AS string), 8, '0')) END
    AS phone,
  CASE WHEN p_partkey % 29 = 0 THEN concat('sc ', lpad(cast(cast(floor(p_partkey / 58.0) AS bigint) AS string), 6, '0')) END
    AS company_number,
  CASE WHEN p_partkey % 31 = 0 THEN concat('place-', cast(cast(floor(p_partkey / 62.0) AS bigint) AS string)) END
    AS place_id,
  CASE p_partkey % 10 WHEN 0 THEN 'new_lead' WHEN 1 THEN 'new_lead' WHEN 2 THEN 'outreach_sent'
    WHEN 3 THEN 'waiting_concierge' WHEN 4 THEN 'follow_up_queued' WHEN 5 THEN 'enriching'
    WHEN 6 THEN 'interested' WHEN 7 THEN 'outreach_sent' WHEN 8 THEN 'verifying'
    ELSE 'follow_up_sent' END AS status,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE cast(p_partkey * 7 % 101 AS int) END AS ch_pre_score,
  CASE WHEN p_partkey % 3 = 0 THEN NULL
       ELSE cast('2024-01-20 00:00:00' AS timestamp) + (p_partkey % 20) * interval '1' day END
    AS next_outreach_window,
  CASE WHEN p_partkey % 4 = 0 THEN 'post-year-end' END AS next_outreach_window_reason,
  cast('2024-01-01 00:00:00' AS timestamp) + p_partkey * interval '1' minute AS created_at,
  cast('2024-01-30 23:00:00' AS timestamp) + (p_partkey % 60) * interval '1' minute AS updated_at,
  CASE WHEN p_partkey % 6 = 0 THEN NULL
       ELSE cast('2024-01-26 00:00:00' AS timestamp) + (p_partkey % 120) * interval '1' hour END
    AS last_contacted_at,
  CASE WHEN p_partkey % 10 = 6 THEN
    cast('2024-01-28 00:00:00' AS timestamp) + (p_partkey % 977) * interval '1' minute END
    AS last_reply_at,
  p_partkey % 4 = 0 AS locked,
  CASE WHEN p_partkey % 8 = 0 THEN
    cast('2024-01-30 23:00:00' AS timestamp) + (p_partkey % 60) * interval '1' minute END AS lock_at,
  cast(p_partkey % 5 AS int) AS research_failures,
  CASE WHEN p_partkey % 3 = 1 THEN
    cast('2024-01-30 12:00:00' AS timestamp) + (p_partkey % 12) * interval '1' hour END
    AS last_research_attempt_at,
  cast(p_partkey % 4 AS int) AS scrape_attempts,
  CASE WHEN p_partkey % 13 = 5 THEN NULL ELSE cast(p_partkey * 31 % 101 AS int) END AS brand_fit_score,
  CASE p_partkey % 3 WHEN 0 THEN 'Tier1' WHEN 1 THEN 'Tier2' ELSE 'Exclude' END AS tier,
  p_partkey % 14 = 2 AS reply_received,
  CASE WHEN p_partkey % 10 = 4 THEN concat('draft-f', cast(p_partkey AS string)) END AS follow_up_draft_id,
  CASE WHEN p_partkey % 10 = 3 THEN concat('draft-', cast(p_partkey AS string)) END AS draft_id,
  CASE WHEN p_partkey % 10 IN (2, 3, 4) THEN concat('conv-', cast(cast(floor(p_partkey / 20.0) AS bigint) AS string)) END
    AS conversation_id,
  CASE WHEN p_partkey % 6 = 1 THEN NULL
       ELSE date '1994-01-01' + cast(p_partkey * 11 % 10000 AS int) END AS incorporated_on,
  CASE WHEN p_partkey % 5 = 2 THEN NULL
       ELSE date '2023-01-31' + cast(p_partkey * 7 % 366 AS int) END AS accounts_last_made_up_to,
  CASE WHEN p_partkey % 8 = 3 THEN NULL
       ELSE date '2024-01-15' + cast(p_partkey * 5 % 300 AS int) END AS accounts_next_due,
  CASE WHEN p_partkey % 7 = 4 THEN date '2023-09-01' + cast(p_partkey % 200 AS int) END
    AS latest_director_appointed_on,
  CASE WHEN p_partkey % 4 = 1 THEN concat('ann ', 'Owner', cast(p_partkey AS string))
       WHEN p_partkey % 4 = 2 THEN 'bob Smith' END AS owner_name,
  CASE WHEN p_partkey % 3 = 2 THEN concat('Maker of ', p_name) END AS description,
  CASE WHEN p_partkey % 6 = 5 THEN concat('GB ', lpad(cast(p_partkey AS string), 9, '1')) END AS vat_number,
  CASE WHEN p_partkey % 12 = 5 THEN date '2024-01-02' END AS vat_checked_on
FROM @part@
"""

VIEWS["research_v"] = """
SELECT lpad(cast(p_partkey AS string), 8, '0') AS lead_id,
  p_partkey % 9 <> 4 AS ok,
  CASE WHEN p_partkey % 5 = 0 THEN concat('res', cast(p_partkey AS string), '@firm.co.uk') END AS email,
  CASE WHEN p_partkey % 6 = 0 THEN '020 7946 0000' END AS phone,
  CASE WHEN p_partkey % 7 = 0 THEN 'Rita Research' END AS owner_name,
  CASE WHEN p_partkey % 4 = 0 THEN 'Researched' END AS description,
  CASE WHEN p_partkey % 3 = 0 THEN concat('https://res', cast(p_partkey AS string), '.co.uk') END AS website
FROM @part@
"""

VIEWS["scrapes_v"] = """
SELECT lpad(cast(p_partkey AS string), 8, '0') AS lead_id,
  CASE WHEN p_partkey % 8 = 1 THEN 'failed' ELSE 'done' END AS outcome,
  CASE WHEN p_partkey % 8 = 2 THEN concat('Scr.', cast(p_partkey AS string), '@Gmail.com') END AS email,
  CASE WHEN p_partkey % 10 = 3 THEN '+44 161 496 0000' END AS phone,
  CASE WHEN p_partkey % 11 = 0 THEN 'Sue Scrape' END AS owner_name,
  CASE WHEN p_partkey % 12 = 0 THEN 'Scraped' END AS description
FROM @part@ WHERE p_retailprice > 910
"""

VIEWS["suppression_v"] = """
SELECT concat('owner', cast(p_partkey AS string), '@mail.com') AS email,
       'replied' AS reason, cast(NULL AS string) AS lead_id,
       cast('2024-01-05 00:00:00' AS timestamp) AS created_at
FROM @part@ WHERE p_size < 8
"""

VIEWS["followups_v"] = """
SELECT concat('q', cast(p_partkey AS string)) AS queue_id,
  lpad(cast(p_partkey AS string), 8, '0') AS lead_id,
  concat('draft-q', cast(p_partkey AS string)) AS draft_id,
  CASE WHEN p_partkey % 4 = 0 THEN 'Hard no detected: closing' ELSE 'No reply yet' END AS reasoning,
  CASE WHEN p_size % 3 = 0 THEN 'approved' ELSE 'pending' END AS queue_status,
  cast('2024-01-25 00:00:00' AS timestamp) + (p_partkey % 499) * interval '1' minute AS queued_at
FROM @part@ WHERE p_size > 20
"""

VIEWS["vat_register_v"] = """
SELECT lpad(cast(p_partkey AS string), 9, '1') AS vrn, p_name AS registered_name
FROM @part@ WHERE p_size % 2 = 0
"""

VIEWS["email_probe_v"] = """
SELECT concat('m', cast(c_custkey AS string), '@x.com') AS email,
  c_custkey % 10 <> 0 AS mx_valid,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 250
       WHEN c_custkey % 3 = 1 THEN 450 ELSE 550 END AS smtp_code,
  c_custkey % 4 = 0 AS catch_all, c_custkey % 11 = 0 AS blocked
FROM @customer@
"""

VIEWS["error_log_v"] = """
SELECT event_id AS id, ts,
  CASE event_type WHEN 'error' THEN 'BOUNCE' WHEN 'purchase' THEN 'EMAIL_SENT'
       WHEN 'signup' THEN 'EMAIL_SENT' WHEN 'click' THEN 'S8_Kill_Switch' ELSE 'S0_Discovery' END
    AS scenario,
  CASE event_type
    WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'SMTP_550' WHEN 1 THEN 'BOUNCE_DETECTED' ELSE 'TIMEOUT' END
    WHEN 'purchase' THEN 'OUTREACH'
    WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'GOODBYE' ELSE 'FOLLOW_UP' END
    WHEN 'click' THEN CASE WHEN value > 80 THEN 'KILL_SWITCH_ACTIVE' ELSE 'NOTE' END
    ELSE 'CH_SCAN_FAILED' END AS error_code,
  CASE WHEN event_id % 9 = 0 THEN '{"subject": broken' ELSE concat(
    '{"leadId":"', cast(user_id AS string), '","subject":"Hello ', cast(event_id AS string), '"',
    CASE WHEN event_id % 4 = 0 THEN ',"sentBy":"amy","wasEdited":true' ELSE '' END,
    CASE WHEN event_id % 2 = 0 THEN ',"direction":"outreach"' ELSE '' END,
    ',"messageId":"m', cast(event_id AS string), '"}') END AS message,
  cast(user_id AS string) AS lead_id,
  event_type = 'click' AND value > 80 AS kill_switch
FROM @events@
"""

VIEWS["call_log_v"] = """
SELECT event_id, concat('svc', cast(user_id % 5 AS string)) AS label, ts,
       event_type NOT IN ('error', 'click', 'view') AS ok
FROM @events@
"""

VIEWS["lock_events_v"] = """
SELECT event_id, ts, lpad(cast(user_id AS string), 8, '0') AS lead_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'lock' ELSE 'unlock' END AS kind
FROM @events@
"""

VIEWS["lead_events_v"] = """
SELECT event_id, ts, lpad(cast(user_id AS string), 8, '0') AS lead_id,
  CASE WHEN event_id % 13 = 0 THEN 'bounce'
    WHEN event_id % 17 = 0 THEN CASE (event_id % 7) WHEN 0 THEN 'subsidiary_found' WHEN 1 THEN 'research_failed'
      WHEN 2 THEN 'research_given_up' WHEN 3 THEN 'scrape_failed' WHEN 4 THEN 'no_email' WHEN 5 THEN 'low_tier' ELSE 'unheard_of' END
    ELSE CASE (event_id % 16)
      WHEN 0 THEN 'start_enrichment' WHEN 1 THEN 'start_verification' WHEN 2 THEN 'verification_passed'
      WHEN 3 THEN 'routed' WHEN 4 THEN 'approve_tier' WHEN 5 THEN 'queue_follow_up'
      WHEN 6 THEN 'approve_follow_up' WHEN 7 THEN 'reject_follow_up' WHEN 8 THEN 'sent_item'
      WHEN 9 THEN 'reply_other' WHEN 10 THEN 'auto_reply' WHEN 11 THEN 'reject_tier2'
      WHEN 12 THEN 'found_duplicate' WHEN 13 THEN 'reply_positive' WHEN 14 THEN 'approve_blocked'
      ELSE 'verification_low' END END AS kind
FROM @events@
"""

VIEWS["messages_v"] = """
SELECT concat('msg', cast(conv_id AS string), '-', cast(turn AS string)) AS message_id,
  CASE conv_id % 7 WHEN 0 THEN ' Postmaster@mx.com' WHEN 1 THEN concat('owner', cast(conv_id * 3 AS string), '@mail.com')
    WHEN 2 THEN concat('Owner', cast(conv_id * 6 AS string), '@Mail.com ')
    ELSE concat('owner', cast(conv_id * 9 AS string), '@mail.com') END AS from_email,
  CASE conv_id % 7 WHEN 1 THEN 'Undeliverable: hello' WHEN 2 THEN 'Out of office until Monday'
    WHEN 3 THEN 'Re: quick question' WHEN 4 THEN NULL WHEN 5 THEN 'Team on holiday' ELSE 'Re: hello' END AS subject,
  concat(CASE conv_id % 7 WHEN 0 THEN concat('Final-Recipient: rfc822; Owner', cast(conv_id * 3 AS string), '@mail.com; x ')
    WHEN 1 THEN concat('Delivery to owner', cast(conv_id * 3 AS string), '@mail.com failed. ')
    WHEN 3 THEN 'Thank you for reaching out to us. We will get back to you. '
    WHEN 4 THEN 'I am currently away from my desk. ' ELSE '' END, text) AS text_body,
  cast('2024-01-10 00:00:00' AS timestamp) + conv_id * interval '1' hour + turn * interval '1' minute AS received_at,
  CASE conv_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'hard_no' WHEN 2 THEN 'neutral' END AS sentiment
FROM @conversations@ WHERE role = 'user'
"""

VIEWS["sent_items_v"] = """
SELECT concat(CASE o_orderkey % 4 WHEN 0 THEN 'draft-' WHEN 1 THEN 'draft-f' WHEN 2 THEN 'draft-q'
              ELSE 'other-' END, cast(o_custkey AS string)) AS message_id,
  o_orderkey AS notification_id,
  CASE WHEN o_orderkey % 5 < 2 THEN concat('conv-', cast(o_custkey % 200 AS string)) END AS conversation_id,
  concat('Subject ', cast(o_orderkey AS string)) AS subject,
  o_orderkey % 17 = 0 AS is_draft,
  o_orderdate AS sent_at,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'amy@firm.com' END AS from_addr,
  CASE o_orderkey % 7 WHEN 0 THEN 'deleted' WHEN 1 THEN 'updated' ELSE 'created' END AS change_type,
  CASE WHEN o_orderkey % 23 = 0 THEN 'forged' ELSE 'secret' END AS client_state
FROM @orders@
"""

VIEWS["runs_v"] = """
SELECT event_id AS run_id, ts AS ran_at, 'register' AS source,
  CASE WHEN event_id % 2 = 0 THEN '62012,70229' ELSE '70229,62012' END AS query,
  concat('Region ', cast(user_id AS string)) AS region,
  cast(CASE WHEN floor(value) % 4 = 0 THEN 0 ELSE floor(value) % 4 - 1 END AS int) AS leads_found
FROM @events@ WHERE event_type = 'view'
"""

VIEWS["scans_v"] = """
SELECT cast(cast(ts AS date) AS string) AS sweep_id, event_id AS scan_ord,
  event_type = 'signup' AS skipped, event_type = 'error' AS failed,
  cast(CASE WHEN event_type IN ('signup', 'error') THEN 0
       WHEN floor(value) % 3 = 0 THEN 0 ELSE floor(value) % 11 END AS int) AS new_leads,
  cast((event_id % 90 + 10) * 1000 AS bigint) AS duration_ms
FROM @events@
"""

VIEWS["places_v"] = """
SELECT concat('scan', cast(s_nationkey AS string)) AS scan_id, s_suppkey AS payload_ord,
  concat('{"places":[{"id":', CASE WHEN s_suppkey % 13 = 0 THEN 'null' ELSE concat('"pl', cast(cast(floor(s_suppkey / 2.0) AS bigint) AS string), '"') END,
    ',"displayName":', CASE s_suppkey % 5 WHEN 0 THEN concat('"', s_name, '"') WHEN 1 THEN '{"text":"  "}'
       ELSE concat('{"text":"', s_name, ' Cafe"}') END,
    ',"businessStatus":', CASE s_suppkey % 7 WHEN 0 THEN '"CLOSED_TEMPORARILY"' WHEN 1 THEN 'null' ELSE '"OPERATIONAL"' END,
    ',"primaryType":', CASE s_suppkey % 11 WHEN 0 THEN '"supermarket"' ELSE '"cafe"' END,
    ',"addressComponents":[{"longText":"5","types":["street_number"]}',
    CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat(',{"longText":"', n_name, '","shortText":"N","types":["political","locality"]}') END,
    ',{"longText":"United Kingdom","shortText":"GB","types":["country"]}',
    CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat(',{"shortText":"ls', cast(s_suppkey % 30 AS string), ' 1ab","types":["postal_code"]}') END,
    '],"formattedAddress":"', cast(s_suppkey AS string), ' Street","websiteUri":"https://s', cast(s_suppkey AS string), '.co.uk"',
    CASE WHEN s_suppkey % 2 = 0 THEN ',"internationalPhoneNumber":"+44 1"' ELSE '' END,
    ',"nationalPhoneNumber":"01","rating":4.5},',
    '{"id":"second', cast(s_suppkey AS string), '","displayName":{"text":"Second"}}]}') AS payload
FROM @supplier@ JOIN @nation@ ON s_nationkey = n_nationkey
"""

VIEWS["site_pages_v"] = """
SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS domain,
  page_ord,
  url,
  CASE WHEN page_id % 29 = 0 THEN 'https://www.dan.com/x' WHEN page_id % 31 = 0 THEN 'https://www.facebook.com/acme'
       WHEN page_id % 37 = 0 THEN '' ELSE url END AS final_url,
  CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN page_id % 43 = 0 THEN '<html>Just a moment</html>' ELSE concat(
   replace(html, '</head>', concat(
    CASE WHEN page_id % 3 = 0 THEN concat('<meta property="og:Title" content="Site ', cast(page_id AS string), '"><meta content="rev" property="og:title"><meta content="A town" property="og:locality">') ELSE '' END,
    CASE WHEN page_id % 4 = 0 THEN '<meta name="description" content="Fish &amp; chips &#163;5 &quot;hot&quot;"><link rel="canonical" href="https://canon.example/x">' ELSE '' END,
    '</head>')),
   '<div>',
   CASE page_id % 6 WHEN 0 THEN '<a href="mailto:Info@Acme.co.uk">mail</a> jane.doe@acme.co.uk logo@2x.png'
     WHEN 1 THEN concat('sales', cast(page_id AS string), '@acme.com and bob@acme.com') ELSE '' END,
   CASE page_id % 5 WHEN 0 THEN '<a href="tel:+44 (0)113 496 0000">call</a>' WHEN 1 THEN '<a href="tel:0113 496 0001">call</a> <a href="tel:2025550123">us</a>' ELSE '' END,
   CASE WHEN page_id % 4 = 1 THEN concat('<p>Registered at LS1 4AP and M1 1AE, EC1A 1BB. VAT No: GB ', lpad(cast(page_id AS string), 9, '3'), '</p>') ELSE '' END,
   CASE WHEN page_id % 8 = 2 THEN '<p>Company GB 987654321 footer</p>' ELSE '' END,
   CASE WHEN page_id % 3 = 1 THEN '<p>Jane Doe, Founder</p><p>Managing Director: Ann Smith</p><p>Jane Doe | Owner</p>' ELSE '' END,
   CASE WHEN page_id % 7 = 3 THEN '<a href="https://www.instagram.com/Acme.Shop/">i</a><a href="https://instagram.com/explore/">e</a><a href="https://www.linkedin.com/company/acme-ltd?x=1">l</a><a href="https://facebook.com/AcmeUK?ref=1">f</a><a href="https://x.com/acme_x">x</a> <a href="https://twitter.com/Acme_T">t</a> <a href="https://www.tiktok.com/@Acme.tok">k</a><a href="https://youtube.com/channel/UC_ab-1">y</a>' ELSE '' END,
   CASE WHEN page_id % 2 = 0 THEN '<a href="/contact-us">c</a><a href="/About/">a</a><a href="/contact/form#top">f</a><a href="/team.pdf">p</a><a href="https://other.org/contact">o</a><a href="#contact">h</a><a href="/our-team?x=1">t</a>' ELSE '' END,
   CASE WHEN page_id % 5 = 2 THEN concat('<script type="application/ld+json">{"@context":"x","@type":["LocalBusiness"],"email":"LD', cast(page_id AS string), '@Acme.com","telephone":"+441134960009","address":{"streetAddress":"1 High St","addressLocality":"Leeds","postalCode":"LS1 4AP"},"sameAs":["https://www.instagram.com/LdShop/","https://www.linkedin.com/company/ld"],"founder":{"@type":"Person","name":"Lee Ader","jobTitle":"CEO"},"employee":[{"name":"Em One","jobTitle":"Chef"},{"name":"Em Two"}]}</script>') ELSE '' END,
   CASE WHEN page_id % 11 = 4 THEN '<script type="application/ld+json">[{"@type":"Person","name":"Deep Down","jobTitle":"Owner"},{"@graph":[{"@type":"Store","email":"graph@acme.com","address":"9 Low Rd"}]}]</script><script type="application/ld+json">{broken</script>' ELSE '' END,
   CASE WHEN page_id % 41 = 0 THEN '<p>This domain is for sale</p>' ELSE '' END,
   '</div>') END AS html
FROM @pages@ JOIN (
  SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/:?#]+)', 1) ORDER BY page_id) - 1 AS page_ord
  FROM @pages@) places USING (page_id)
"""

VIEWS["site_fill_v"] = """
SELECT domain, CASE WHEN count(*) % 3 = 0 THEN 'Fill Owner' END AS owner_name,
  CASE WHEN count(*) % 4 = 0 THEN NULL WHEN count(*) % 2 = 0 THEN 'Info@acme.co.uk' ELSE 'ghost@acme.com' END AS email,
  CASE WHEN count(*) % 4 < 2 THEN 'A description' END AS description
FROM @site_pages_v@ GROUP BY domain
"""

VIEWS["robots_v"] = """
SELECT page_id AS origin_id, concat('# robots', chr(10), 'User-agent: ',
  CASE page_id % 3 WHEN 0 THEN '*' WHEN 1 THEN 'BadBot' ELSE 'Googlebot' END, chr(10),
  CASE page_id % 5 WHEN 0 THEN 'Disallow: /' WHEN 1 THEN 'DISALLOW : /* ' WHEN 2 THEN 'Disallow: /private'
    WHEN 3 THEN 'Disallow:' ELSE '# Disallow: /' END, chr(10), chr(10),
  'user-agent: ', CASE page_id % 2 WHEN 0 THEN 'Other' ELSE '*' END, chr(13), chr(10),
  CASE page_id % 7 WHEN 0 THEN 'disallow: /' ELSE 'allow: /' END) AS body
FROM @pages@
"""

VIEWS["sitemaps_v"] = """
SELECT domain, concat('<urlset><url><loc> https://', domain, '/about-team </loc></url><url><loc>https://', domain,
  '/blog/1</loc></url><url><loc>https://', domain, '/services</loc></url><url><LOC>https://', domain,
  '/people/all</LOC></url></urlset>') AS xml
FROM @site_pages_v@ WHERE page_ord = 0
"""



def _named(**fields: str) -> str:
    """SQL of the JSON fields that are known, each with a comma before it; a value is an expression of JSON text."""
    return ", ".join(
        f"""CASE WHEN {value} IS NULL THEN '' ELSE concat(',"{name}":', {value}) END""" for name, value in fields.items()
    )


def _text(c: str) -> str:
    return f"""concat('"', cast({c} AS string), '"')"""


def _texts(*names: str) -> dict[str, str]:
    return {n: f"CASE WHEN {n} IS NOT NULL THEN {_text(n)} END" for n in names}


def _flags(**names: str) -> dict[str, str]:
    return {n: f"cast({c} AS string)" for n, c in names.items()}


def _dated(**names: str) -> dict[str, str]:
    return {n: f"CASE WHEN {c} IS NOT NULL THEN {_text(c)} END" for n, c in names.items()}


VIEWS["profiles_v"] = f"""
SELECT company_number, 'profile' AS resource,
  concat('{{"company_number":" ', lower(company_number), '"', {_named(
      **_texts("company_name", "company_status", "date_of_creation"), **_dated(type="company_type"),
      sic_codes="CASE WHEN sic_csv IS NOT NULL THEN concat('[\"', replace(sic_csv, ',', '\",\"'), '\"]') END",
      **_flags(has_been_liquidated="has_been_liquidated", has_insolvency_history="has_insolvency_history"))},
    ',"registered_office_address":{{"x":0', {_named(
      **_texts("address_line_1", "address_line_2", "locality", "region", "postal_code", "country"))},
    '}},"accounts":{{"x":0', {_named(
      **_texts("accounts_category"), **_dated(next_due="accounts_next_due"), **_flags(overdue="accounts_overdue"))},
    ',"last_accounts":{{"x":0', {_named(**_dated(type="last_accounts_type", made_up_to="last_made_up_to"))},
    '}}}},"confirmation_statement":{{"x":0', {_named(
      **_flags(overdue="confirmation_overdue"), **_dated(next_due="confirmation_next_due"))}, '}}}}') AS payload
FROM @companies_v@
"""

VIEWS["payloads_v"] = """
SELECT concat(' ', lower(company_number), ' ') AS company_number, 'officers' AS resource,
  concat('{"items":[', string_agg(concat('{"name":"', name, '","officer_role":"', officer_role, '"',
    CASE WHEN appointed_on IS NULL THEN '' ELSE concat(',"appointed_on":"', cast(appointed_on AS string), '"') END,
    CASE WHEN resigned_on IS NULL THEN '' ELSE concat(',"resigned_on":"', cast(resigned_on AS string), '"') END,
    CASE WHEN dob_year IS NULL THEN '' ELSE concat(',"date_of_birth":{"month":', cast(dob_month AS string), ',"year":', cast(dob_year AS string), '}') END,
    '}'), ','), ']}') AS payload
FROM @officers_v@ GROUP BY company_number
UNION ALL
SELECT company_number, 'filing-history', concat('{"items":[', string_agg(concat('{"category":"', category, '"',
    CASE WHEN filing_date IS NULL THEN '' ELSE concat(',"date":"', cast(filing_date AS string), '"') END,
    CASE WHEN document_link IS NULL THEN '' ELSE concat(',"links":{"document_metadata":"', document_link, '"}') END, '}'), ','), ']}')
FROM @filings_v@ GROUP BY company_number
UNION ALL
SELECT company_number, 'charges', concat('{"items":[', string_agg(concat('{"status":"', status, '"',
    CASE WHEN created_on IS NULL THEN '' ELSE concat(',"created_on":"', cast(created_on AS string), '"') END, '}'), ','), ']}')
FROM @charges_v@ GROUP BY company_number
UNION ALL
SELECT company_number, 'persons-with-significant-control', concat('{"items":[', string_agg(concat('{"name":"', name, '"',
    CASE WHEN kind IS NULL THEN '' ELSE concat(',"kind":"', kind, '"') END,
    CASE WHEN ceased_on IS NULL THEN '' ELSE concat(',"ceased_on":"', cast(ceased_on AS string), '"') END, '}'), ','), ']}')
FROM @psc_v@ GROUP BY company_number
"""

VIEWS["responses_v"] = """
SELECT p_partkey AS response_id, concat(CASE WHEN p_partkey % 4 = 0 THEN concat('```json', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 9 = 0 THEN 'Here you are: ' ELSE '' END,
  '[{"businessName":"', p_name, ' ] {','","city":', CASE WHEN p_partkey % 3 = 0 THEN '7' ELSE concat('"', p_type, '"') END,
  ',"nested":{"a":[1]}},{"businessName":', CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE concat('"', p_brand, '"') END,
  ',"website":"https://x', cast(p_partkey AS string), '.com","source":"Web"},{"businessName":"Third","ownerName":"O',
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '"}]' END,
  CASE WHEN p_partkey % 4 = 0 THEN concat(chr(10), '```') ELSE '' END) AS raw
FROM @part@
"""

VIEWS["scrape_cache_v"] = """
SELECT domain, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'a@b.com' END AS email,
  CASE WHEN page_id % 2 = 0 THEN 'low' ELSE 'high' END AS confidence,
  cast('2024-01-31 00:00:00' AS timestamp) - (page_id % 200) * interval '1' hour AS fetched_at
FROM @site_pages_v@ WHERE page_ord = 0
"""

VIEWS["regions_v"] = """
SELECT n_nationkey AS region_id, concat(cast(n_nationkey * 8 - 91 AS string), '.25, ', cast(n_nationkey * 15 - 185 AS string), '.5,',
  CASE WHEN n_nationkey % 7 = 0 THEN 'wide' ELSE cast(n_nationkey * 2500 + 50 AS string) END,
  CASE WHEN n_nationkey % 11 = 0 THEN ',extra' ELSE '' END) AS region
FROM @nation@
"""

_NAME = re.compile(r"@(\w+)@")


#: A session setting: over how many tasks the rows of the text tables are dealt. Only for small
#: tables whose one file cannot be split; unset, Spark's own file settings decide.
SPLITS = "spark.leadloom.input.splits"


#: The tables of texts, and the views that make texts of narrow rows.
DEALT = ("pages", "documents", "accounts_docs_v")


def splits(spark: SparkSession) -> int:
    return int(spark.conf.get(SPLITS, "0"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(splits(spark)) if name in DEALT and splits(spark) else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table or one of the views over them."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    parts = {n: view(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(text))}
    body = _NAME.sub(r"{\1}", text.replace("{", "{{").replace("}", "}}"))
    if name in DEALT and splits(spark):
        parts = {n: df.repartition(splits(spark)) for n, df in parts.items()}
    return prepare(spark).sql(body, **parts)


def stream_view(spark: SparkSession, sf_dir: str, name: str, base: str) -> DataFrame:
    """A view over one table, read as a stream of the table's file, or of its parts if it is a folder."""
    prepare(spark)
    schema = table(spark, sf_dir, base).schema
    files = spark.readStream.schema(schema)
    path = f"{sf_dir}/{base}.parquet"
    found = spark.read.format("binaryFile").load(path).select("path").head()  # names only, nothing is read
    if found is None or not found.path.endswith(f"/{base}.parquet"):
        source = files.parquet(path)
    else:
        source = files.option("pathGlobFilter", f"{base}.parquet").parquet(sf_dir)
    body = _NAME.sub(r"{\1}", VIEWS[name].replace("{", "{{").replace("}", "}}"))
    return spark.sql(body, **{base: source})


def _needed(name: str, seen: dict[str, str]) -> None:
    if name in VIEWS and name not in seen:
        for part in dict.fromkeys(_NAME.findall(VIEWS[name])):
            _needed(part, seen)
        seen[name] = _NAME.sub(r"\1", VIEWS[name]).strip()


def with_views(sql: str) -> str:
    """DuckDB text in which every ``@view@`` is defined by a WITH clause."""
    seen: dict[str, str] = {}
    for name in dict.fromkeys(_NAME.findall(sql)):
        _needed(name, seen)
    body = _NAME.sub(r"\1", sql).strip()
    if not seen:
        return body
    heads = ",\n".join(f"{n} AS ({t})" for n, t in seen.items())
    if re.match(r"(?i)with\s+recursive\s", body):
        return f"WITH RECURSIVE {heads},\n{body[len('WITH RECURSIVE'):].lstrip()}"
    if re.match(r"(?i)with\s", body):
        return f"WITH {heads},\n{body[4:].lstrip()}"
    return f"WITH {heads}\n{body}"
