"""Named queries, by subject."""

from pageloom.plans.crawls import crawls
from pageloom.plans.html import html
from pageloom.plans.schemas import schemas
from pageloom.plans.sites import sites
from pageloom.plans.tasks import tasks
from pageloom.plans.web import web

CATALOGS = [sites, web, html, crawls, schemas, tasks]
