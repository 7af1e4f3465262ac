"""Declared schemas of the inputs; jobs never infer one."""

COMPANIES = """company_number string, company_name string, company_status string, company_type string,
 date_of_creation date, address_line_1 string, address_line_2 string, locality string, region string,
 postal_code string, country string, sic_csv string, accounts_category string, accounts_next_due date,
 accounts_overdue boolean, last_accounts_type string, last_made_up_to date, confirmation_overdue boolean,
 confirmation_next_due date, has_been_liquidated boolean, has_insolvency_history boolean"""

LEADS_IN = """business_name string, city string, address string, website_url string, phone string,
 email string, outward_postcode string, company_number string, place_id string"""

PROFILE = """company_number string, company_name string, company_status string, type string,
 date_of_creation date, registered_office_address struct<address_line_1:string, address_line_2:string,
 locality:string, region:string, postal_code:string, country:string>, sic_codes array<string>,
 accounts struct<accounts_category:string, next_due:date, overdue:boolean,
 last_accounts:struct<type:string, made_up_to:date>>,
 confirmation_statement struct<overdue:boolean, next_due:date>,
 has_been_liquidated boolean, has_insolvency_history boolean"""

# item schema of each company sub-resource payload
RESOURCES = {
    "officers": """name string, officer_role string, appointed_on date, resigned_on date,
 occupation string, nationality string, country_of_residence string,
 date_of_birth struct<month:int, year:int>""",
    "filing-history": """type string, category string, date date, description string,
 links struct<document_metadata:string>""",
    "charges": "status string, created_on date, satisfied_on date, delivered_on date",
    "persons-with-significant-control": """name string, kind string, natures_of_control array<string>,
 notified_on date, ceased_on date""",
}

PLACES = """places array<struct<id:string, displayName:string, businessStatus:string, primaryType:string,
 addressComponents:array<struct<longText:string, shortText:string, types:array<string>>>,
 formattedAddress:string, shortFormattedAddress:string, websiteUri:string,
 internationalPhoneNumber:string, nationalPhoneNumber:string, rating:double>>"""
