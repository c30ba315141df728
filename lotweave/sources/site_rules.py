"""Mapping rules of the known sites.

Fixed values: each site's fields and selectors, in the order a mapping file lists them.
"""

from __future__ import annotations

SITE_RULES: dict[str, dict[str, str | dict[str, str]]] = {
    "cars_com": {
        "_metadata": {"site": "cars.com", "version": "1.0.0"},
        "vin": "//span[@data-qa='vin-value']/text()",
        "goal": "Buy a quality pre-owned vehicle from Cars.com",
        "year": ".vehicle-info__year",
        "make": ".vehicle-info__make",
        "model": ".vehicle-info__model",
        "trim": ".vehicle-info__trim",
        "price": "//span[@class='primary-price']//text()",
        "mileage": ".vehicle-info__mileage",
        "color": ".vehicle-info__color",
        "dealer.name": ".dealer-name",
        "dealer.phone": ".dealer-phone",
        "dealer_address": ".dealer-address",
        "features": ".vehicle-features li",
        "images": ".vehicle-photos img",
        "description": ".vehicle-description",
        "fuel_type": ".fuel-type",
        "transmission": ".transmission",
        "drivetrain": ".drivetrain",
        "engine": ".engine-info",
        "carfax_available": ".carfax-link",
        "certified": ".certified-badge",
        "warranty": ".warranty-info",
        "listing_date": ".listing-date",
        "days_on_lot": ".days-on-lot",
        "stock_number": ".stock-number",
    },
    "carfax": {
        "_metadata": {"site": "carfax.com", "version": "1.0.0"},
        "vin": "//span[@data-test='vin-value']/text()",
        "goal": "Purchase a Carfax-verified vehicle with complete history",
        "year": ".vehicle-year",
        "make": ".vehicle-make",
        "model": ".vehicle-model",
        "trim": ".vehicle-trim",
        "price": "//div[@class='price-display']//span/text()",
        "mileage": ".mileage-value",
        "color": ".exterior-color",
        "dealer.name": ".dealer-info h3",
        "dealer.phone": ".dealer-phone a",
        "dealer_rating": ".dealer-rating",
        "features": ".features-list li",
        "images": ".photo-gallery img",
        "description": ".vehicle-overview p",
        "carfax_report": ".carfax-report-link",
        "accident_history": ".accident-indicator",
        "service_records": ".service-count",
        "owner_count": ".owner-count",
        "title_info": ".title-status",
        "usage_type": ".usage-type",
        "location": ".vehicle-location",
        "mpg_city": ".mpg-city",
        "mpg_highway": ".mpg-highway",
        "fuel_type": ".fuel-type",
    },
    "default": {
        "_metadata": {"site": "default", "version": "1.0.0"},
        "vin": "//span[contains(@class, 'vin')]/text()",
        "goal": "Purchase a quality pre-owned vehicle",
        "year": ".vehicle-year",
        "make": ".vehicle-make",
        "model": ".vehicle-model",
        "price": "//span[contains(@class, 'price')]/text()",
        "mileage": ".mileage",
        "color": ".color",
        "dealer.name": ".dealer-name",
        "dealer.phone": ".dealer-phone",
        "features": ".features li",
        "images": ".vehicle-photos img",
        "description": ".description",
    },
}
